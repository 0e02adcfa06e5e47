"""From a question to a tool, a catalog, tables: matching, evidence, joins, suggestions."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field

from ..functions import modifiers, periods
from ..sources.footers import Horizons
from .catalog import Catalog
from .dialect import SPARK
from .tools import Tool
from .values import tokens_of


@dataclass(frozen=True)
class Match:
    """A pattern that leads to a tool: ``groups`` names the parameters that its groups give."""

    pattern: str
    tool: str
    groups: tuple[str, ...] = ()
    unless: str | None = None
    needs_window: bool = False
    upper: tuple[str, ...] = ()
    whole: tuple[str, ...] = ()


def match_tool(question: str, matches: list[Match], tools: dict[str, Tool], today: dt.date) -> tuple[Tool, dict, modifiers.Modifiers] | None:
    """The first match wins. A range that ends before it begins matches nothing; no word of the question becomes SQL."""
    text, mods = modifiers.strip(question)
    for m in matches:
        hit = re.search(m.pattern, text, re.I)
        if not hit or (m.unless and re.search(m.unless, text, re.I)):
            continue
        params: dict = {}
        for name, value in zip(m.groups, hit.groups()):
            if value is not None:
                params[name] = int(value) if name in m.whole else value.upper() if name in m.upper else value
        if m.needs_window:
            if (w := periods.window(text, today)) is None:
                return None
            (params["from"], params["to"]), params["period"] = w
        return tools[m.tool], params, mods
    return None


@dataclass(frozen=True)
class Source:
    """What is known of a database when it is to be chosen. ``factories``: those whose data alone it holds; ``synonyms``:
    further words for its own; ``similarity``: to the question, by vectors, where there are any."""

    name: str
    keywords: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()
    factories: tuple[str, ...] = ()
    values: tuple[str, ...] = ()
    similarity: float = 0.0
    synonyms: tuple[tuple[str, str], ...] = ()
    curated: bool = False
    routable: bool = True


@dataclass(frozen=True)
class Evidence:
    name: str
    score: float
    hits: float
    share: float


def padded(text: str) -> str:
    """Words between single spaces, with one before and behind, so that a phrase is found as whole words only."""
    return f" {' '.join(re.findall(r'[^\W_]+', text.lower()))} "


def prepared(question: str, source: Source) -> str:
    """The question with compounds of the source's names taken apart and its own words beside their synonyms."""
    parts = {"".join(w): " ".join(w) for n in (source.name, *source.columns) if len(w := re.findall(r"[a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", n).lower())) > 1}
    said = padded(question)
    more = [parts[w] for w in said.split() if w in parts] + [own for word, own in source.synonyms if padded(word) in said]
    return padded(" ".join([question, *more]))


def _hits(question: str, source: Source) -> float:
    """3 a keyword, 1 a column (its name, or its words in a row), 3 a recorded value: as whole words, each once."""
    said = prepared(question, source)
    found = lambda names: sum(padded(n) in said for n in dict.fromkeys(names) if padded(n).strip())
    columns = sum(any(padded(x) in said for x in (c, re.sub(r"(?<=[a-z])(?=[A-Z])", " ", c))) for c in source.columns)
    return 3.0 * found(source.keywords) + columns + 3.0 * found(source.values)


def factory_points(question: str, source: Source, codes: tuple[str, ...] = (), factory: str | None = None) -> float:
    """4 for a source of a factory that is asked for, -4 if only others are, 0 for one of all factories or if none is."""
    if not source.factories:
        return 0.0
    said = padded(question)
    named = {c.upper() for c in (*codes, *source.factories) if padded(c) in said} | ({factory.upper()} if factory else set())
    return 0.0 if not named else 4.0 if named & {f.upper() for f in source.factories} else -4.0


def evidence(question: str, sources: list[Source], codes: tuple[str, ...] = (), factory: str | None = None) -> list[Evidence]:
    """The sources that may be chosen, best first: hits, twice the share of the name's words, half a point for curated
    views, factory points, and where half of the sources have a similarity 2 for the most alike and 1 for the next. Ties
    go to the larger share, then to more hits, then by name."""
    sources = [s for s in sources if s.routable]
    alike = sorted((s for s in sources if s.similarity > 0), key=lambda s: -s.similarity)
    bonus = {s.name: b for s, b in zip(alike, (2.0, 1.0))} if 2 * len(alike) >= len(sources) else {}
    out = []
    for s in sources:
        words, name = set(prepared(question, s).split()), modifiers.words_of(s.name)
        share, hits = len(name & words) / max(1, len(name)), _hits(question, s)
        out.append(Evidence(s.name, hits + 2 * share + bonus.get(s.name, 0.0) + 0.5 * s.curated + factory_points(question, s, codes, factory), hits, share))
    return sorted(out, key=lambda e: (-e.score, -e.share, -e.hits, e.name))


def pick(question: str, sources: list[Source], factory: str | None = None, most: int = 1, margin: float = 2.0, codes: tuple[str, ...] = ()) -> list[str]:
    """The best ``most`` sources with any evidence, and the next one if it has as many hits as the last of them and is
    within the margin."""
    found = [e for e in evidence(question, sources, codes, factory) if e.score > 0]
    close = len(found) > most and found[most].hits > 0 and found[most].hits >= found[most - 1].hits and found[most - 1].score - found[most].score <= margin
    return [e.name for e in found[: most + close]]


def pick_agent(question: str, agents: dict[str, tuple[str, ...]], owner: str | None = None, databases: dict[str, str] | None = None) -> str | None:
    """A tool's owner, else the one with most keywords; a tie is settled by a database, else there is none."""
    if owner:
        return owner
    said = padded(question)
    hits = {a: sum(padded(k) in said for k in words) for a, words in agents.items()}
    best = [a for a, n in hits.items() if n == max(hits.values()) and n > 0]
    if len(best) > 1 and databases:
        best = [a for a in best if a in databases.values()]
    return best[0] if len(best) == 1 else None


@dataclass(frozen=True)
class TableInfo:
    name: str
    columns: tuple[str, ...]
    keys: tuple[str, ...] = ()
    foreign: dict[str, str] = field(default_factory=dict)


def neighbours(tables: list[TableInfo], names: list[str]) -> list[str]:
    """Tables one foreign key away, in either direction."""
    out = {t for x in tables if x.name in names for t in x.foreign.values()} | {x.name for x in tables if set(x.foreign.values()) & set(names)}
    return sorted(out - set(names))


def join_hints(a: TableInfo, b: TableInfo) -> list[tuple[str, str]]:
    """Column pairs that may join: one name in both that is a key, or TableId with the table's Id; never Id with Id."""
    same = [(c, c) for c in a.columns if c in b.columns and c.lower() != "id" and (c in a.keys or c in b.keys)]
    named = [(c, k) for x, y, flip in ((a, b, False), (b, a, True)) for c in x.columns for k in y.keys if k.lower() == "id" and c.lower() == f"{y.name.lower()}id" for c, k in [((k, c) if flip else (c, k))]]
    return list(dict.fromkeys(same + named))


def search_tables(question: str, tables: list[TableInfo], k: int = 6, vectors: dict[str, float] | None = None) -> list[str]:
    """Tables by fused ranks: similarity, words of name and columns, share of the name, columns hit (three or more)."""
    words = tokens_of(question)
    lists = []
    if vectors:
        lists.append(sorted(vectors, key=lambda n: (-vectors[n], n)))
    score = {
        "words": lambda t: len(words & set().union(modifiers.words_of(t.name), *map(modifiers.words_of, t.columns))),
        "name": lambda t: len(words & modifiers.words_of(t.name)) / max(1, len(modifiers.words_of(t.name))),
        "columns": lambda t: (n if (n := sum(bool(words & modifiers.words_of(c)) for c in t.columns)) >= 3 else 0),
    }
    for f in score.values():
        lists.append([t.name for t in sorted((t for t in tables if f(t) > 0), key=lambda t: (-f(t), t.name))])
    total: dict[str, float] = {}
    for ranked in lists:
        for rank, name in enumerate(ranked, 1):
            total[name] = total.get(name, 0) + 1 / (60 + rank)
    return sorted(total, key=lambda n: (-total[n], n))[:k]


def suggestions(question: str, tools: list[tuple[str, str, str]], agent: str | None = None, agents: dict[str, str] | None = None) -> list[str]:
    """Tools to offer where nothing was found, from (name, example, description): at least two points."""
    words = tokens_of(question)
    points = [(2 * len(words & tokens_of(e)) + len(words & tokens_of(d)) + 2 * (agent is not None and (agents or {}).get(n) == agent), i, n) for i, (n, e, d) in enumerate(tools)]
    return [n for p, _, n in sorted(points, key=lambda x: (-x[0], x[1])) if p >= 2]


def beyond(newest: dt.date | None, asked: tuple[dt.date, dt.date]) -> str | None:
    """A note where the data end before the period that was asked for."""
    return f"data end on {newest}" if newest and newest < asked[1] - dt.timedelta(1) else None


def run_pasted(loaded, sql: str, max_rows: int = 200, horizons: Horizons | None = None):
    """A statement that a user pasted, under the same rules: guarded, over the scoped views, capped. A view is as large as
    the largest table below it, whose rows its footers tell."""
    from .catalog import TABLES
    from .guard import guard

    catalog: Catalog = loaded.catalog
    offered = {n: v for n, v in catalog.views.items() if not v.base}
    horizons = horizons or Horizons(loaded.spark)
    rows = {}
    for name in offered:
        if re.search(rf"\b{name}\b", sql, re.I):
            bodies = " ".join(v.sql(SPARK) for v in catalog.needed(name))
            rows[name] = max((horizons.rows(loaded.folder, t) for t in TABLES if re.search(rf"\b{t}\b", bodies)), default=0)
    return loaded.sql(guard(loaded.spark, sql, set(offered), rows=rows, columns={n: v.kinds for n, v in offered.items()}, max_rows=max_rows))
