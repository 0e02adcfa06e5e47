"""Words for order and number of rows: "sorted by", "top 5", "last 3 rows"; and columns by loose names."""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Modifiers:
    sort: str | None = None
    descending: bool = False
    limit: int | None = None
    from_end: bool = False


def strip(text: str) -> tuple[str, Modifiers]:
    """The text without its modifiers, and these."""
    sort, descending, limit, end = None, False, None, False
    if m := re.search(r"[,;]?\s*\b(?:sort(?:ed)?|order(?:ed)?)\s+by\s+([a-z][\w ]*?)(?:\s+(asc(?:ending)?|desc(?:ending)?|highest first|lowest first))?\s*$", text, re.I):
        sort, descending, text = m[1].strip(), (m[2] or "").lower().startswith(("desc", "highest")), text[: m.start()]
    if m := re.search(r"\b(top|bottom|first|last|only)\s+(\d+)(?:\s+(?:rows?|entries|results?))?\b", text, re.I):
        if not re.match(r"\s*days?|\s*weeks?|\s*months?", text[m.end() :], re.I):
            limit, end = int(m[2]), m[1].lower() in ("bottom", "last")
            text = text[: m.start()] + text[m.end() :]
    return re.sub(r"\s{2,}", " ", text).strip(" ,;"), Modifiers(sort, descending, limit, end)


def words_of(name: str) -> set[str]:
    return {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", name.replace("_", " "))}


def resolve_column(asked: str, columns: list[str], synonyms: dict[str, str] | None = None) -> str | None:
    """The column meant: exact, by its words, a synonym, the only one with all words, with any of them, or one much like it."""
    low = {c.lower(): c for c in columns}
    a = asked.strip().lower()
    if a in low:
        return low[a]
    spaced = {" ".join(re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", c.replace("_", " "))).lower(): c for c in columns}
    if a in spaced:
        return spaced[a]
    if synonyms and (c := synonyms.get(a)) in columns:
        return c
    wanted = words_of(asked)
    for test in (lambda c: wanted <= words_of(c), lambda c: bool(wanted & words_of(c))):
        hits = [c for c in columns if wanted and test(c)]
        if len(hits) == 1:
            return hits[0]
        if hits:
            break
    close = difflib.get_close_matches(a, list(spaced), 1, 0.85)
    return spaced[close[0]] if close else None


SENSITIVE = "password passwd secret token salary wage bank account passport national birth gender religion blood phone mobile email address nid".split()


def sensitive(name: str, patterns: list[str] | None = None) -> bool:
    """Patterns of five letters or more match anywhere in a column's name, shorter ones a whole word or its plural."""
    words, joined = words_of(name), re.sub(r"[\W_]", "", name.lower())
    return any((p in joined) if len(p) >= 5 else (p in words or p + "s" in words) for p in (patterns or SENSITIVE))
