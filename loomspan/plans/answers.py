"""What surrounds a query: reading a follow-up, asking again, repairing an empty answer, checking and describing it."""

from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.modifiers import resolve_column, strip
from ..operators.refine import Filter, RefinePlan, Refused, additive, bare_filter
from .catalog import Loaded
from .tools import Tool
from .values import CUTOFF, GAP, closest

OPS = {"is not": "neq", "not": "neq", "is": "eq", "=": "eq", "over": "gt", "above": "gt", "more than": "gt", ">": "gt", "at least": "gte", ">=": "gte", "under": "lt", "below": "lt", "less than": "lt", "<": "lt", "at most": "lte", "<=": "lte", "contains": "contains", "containing": "contains"}


def typed_value(df: DataFrame, column: str, text: str):
    kind = df.schema[column].dataType
    text = text.strip().strip("'\"")
    if isinstance(kind, T.NumericType):
        return float(text.replace(",", "")) if re.fullmatch(r"-?[\d,]*\.?\d+", text) else text
    return dt.date.fromisoformat(text) if isinstance(kind, T.DateType) and re.fullmatch(r"\d{4}-\d\d-\d\d", text) else text


def parse(text: str, df: DataFrame) -> RefinePlan | None:
    """A follow-up ("only ASIA, top 5 by qty", "total of OrderQty", "group by Buyer", "page 2") as a plan over the rows
    that are shown; None if it is none."""
    columns = [c for c in df.columns if c != "__pos"]
    rest, mods = strip(text)
    low = rest.lower().strip(" ?.")
    if m := re.fullmatch(r"(?:show )?(?:page|next page) ?(\d*)", low):
        return RefinePlan(page=int(m[1] or 2))
    plan: dict = {}
    if m := re.search(r"\b(?:group(?:ed)?|break(?:down)?|split)\s+by\s+([\w ]+?)(?=$|,|\bwhere\b|\bfor\b)", low):
        plan["group_by"] = resolve_column(m[1], columns)
    elif re.search(r"\bhow many\b|\bcount\b", low):
        m = re.search(r"\b(?:how many|count)(?: of)?(?: different| distinct)\s+([\w ]+?)(?=$|,|\bwhere\b)", low)
        plan["scalar"] = ("count", resolve_column(m[1], columns) if m else None)
    elif m := re.search(r"\b(?:distinct|unique|different|list of)\s+([\w ]+?)(?=$|,|\bwhere\b)", low):
        plan["distinct"] = resolve_column(m[1], columns)
    elif m := re.search(r"\b(?:total|sum)(?:\s+of)?\s+([\w ]+?)(?=$|,|\bwhere\b|\bfor\b)", low):
        column = resolve_column(m[1], columns)
        if column and not additive(df, column):
            raise Refused(f"{column} is not added up")
        plan["scalar"] = ("total", column) if column else None
    filters = []
    if m := re.search(r"\b(?:where|with|only|for)\s+(.+)$", rest, re.I):
        for part in re.split(r"\s+and\s+|,", m[1]):
            names = "|".join(sorted(map(re.escape, OPS), key=len, reverse=True))
            if c := re.match(rf"\s*([\w ]+?)\s*(?<![\w])({names})(?![\w])\s*(.+)$", part, re.I):
                if column := resolve_column(c[1], columns):
                    filters.append(Filter(column, OPS[c[2].lower()], typed_value(df, column, c[3])))
                    continue
            if part.strip():
                filters.append(bare_filter(df, [part.strip()]))
    if mods.sort:
        column = resolve_column(mods.sort, columns)
        plan["sort"] = (column, mods.descending) if column else None
    made = RefinePlan(tuple(filters), limit=mods.limit, from_end=mods.from_end, **{k: v for k, v in plan.items() if v})
    return None if made == RefinePlan() else made


def needs_requery(plan: RefinePlan, columns: list[str], capped: bool) -> str | None:
    """Why the rows at hand don't do."""
    if plan.page:
        return "another page"
    if capped and (plan.filters or plan.group_by or plan.distinct or plan.scalar or plan.sort):
        return "the rows were cut at their cap"
    missing = [f.column for f in plan.filters if f.column not in columns] + [c for c in (plan.group_by, plan.distinct) if c and c not in columns]
    return f"no column {missing[0]}" if missing else None


def requery(loaded: Loaded, tool: Tool, params: dict, plan: RefinePlan, size: int = 200) -> DataFrame:
    """The cheapest way that does: a page of the tool's own order, else the tool again with the plan's equalities as
    parameters and without its cap, and the rest of the plan over all its rows."""
    from dataclasses import replace

    from ..operators import refine

    whole = replace(tool, top=2_000_000_000)
    if plan.page:
        df = whole.frame(loaded, **params)
        keys = [F.col(o.split()[0]).desc_nulls_last() if o.endswith(" desc") else F.col(o.split()[0]).asc_nulls_last() for o in tool.order]
        return refine.page(df, keys, plan.page, size)
    own = {f.column: f.param for f in tool.filters if f.op == "eq" and f.param}
    bound = {own[f.column]: f.value for f in plan.filters if f.op == "eq" and f.column in own}
    rest = tuple(f for f in plan.filters if not (f.op == "eq" and f.column in own))
    df = whole.frame(loaded, **{**params, **bound})
    return refine.apply(df, replace(plan, filters=rest))


def repair(loaded: Loaded, tool: Tool, params: dict) -> tuple[DataFrame, dict[str, str]]:
    """An empty answer asked again with recorded spellings: each text equality's column is listed (distinct, in the
    scope), and a value that clearly means one of those replaces what was asked. Returns the frame and what changed.

    Spellings alike enough to matter have few edits for their lengths, so all values are looked at and those few compared.
    """
    first = tool.frame(loaded, **params)
    if first.take(1):
        return first, {}
    changed = {}
    asked = tool.params | params
    for f in tool.filters:
        if f.op == "eq" and f.param and isinstance(asked.get(f.param), str) and asked[f.param]:
            asked_for, recorded = F.lit(asked[f.param].lower()), F.lower(F.col(f.column))
            near = F.levenshtein(recorded, asked_for) <= (1 - CUTOFF + GAP) * (F.length(recorded) + F.length(asked_for))
            known = [r[0] for r in loaded.view(tool.view).select(f.column).distinct().where(near).collect()]
            if (best := closest(asked[f.param], known)) and best != asked[f.param]:
                changed[f.param] = best
    return (tool.frame(loaded, **{**params, **changed}), changed) if changed else (first, {})


def blank(rows: list) -> bool:
    """No rows, or one cell that says nothing."""
    return not rows or (len(rows) == 1 and len(rows[0]) == 1 and rows[0][0] in (None, 0, ""))


def unsupported(text: str, cited: list) -> list[str]:
    """Numbers and codes of an answer that no cited row holds."""
    pool = {cell_text(v).replace(",", "") for row in cited for v in row}
    pool |= {w for p in pool for w in re.findall(r"[A-Za-z]*\d[\w.-]*", p)}
    return [x for x in re.findall(r"[A-Za-z]*\d[\w.,-]*\w|\d", text) if x.replace(",", "").rstrip(".") not in pool]


def cell_text(value: object) -> str:
    if value is None:
        return "—"
    if isinstance(value, dt.datetime):
        return value.date().isoformat() if value.time() == dt.time() else value.isoformat(" ", "minutes")
    if isinstance(value, (Decimal, float)):
        return f"{value:f}".rstrip("0").rstrip(".") if "." in f"{value:f}" else f"{value:f}"
    return str(value)


def chart_columns(df: DataFrame, rows: list) -> tuple[str, str] | None:
    """Label and value of a result that a bar chart can show: two columns, 2 to 25 rows, labels once, numbers."""
    if len(df.columns) != 2 or not 2 <= len(rows) <= 25:
        return None
    label, value = df.columns
    if not isinstance(df.schema[value].dataType, T.NumericType) or len({r[0] for r in rows}) != len(rows) or any(r[1] is None for r in rows):
        return None
    return label, value


def describe(tool: Tool, params: dict | None = None) -> str:
    """A tool's question as a sentence."""
    p, dims, measures, order = tool.chosen(params or {})
    said = [f"{f.column} {'from' if f.op == 'ge' else 'before' if f.op == 'lt' else f.op} {f.of(p)}" if f.op not in ("null", "latest") else f"{f.column} {'missing' if f.op == 'null' else 'on the newest day'}" for f in tool.filters if f.given(p)]
    head = (", ".join(measures) + (f" by {', '.join(dims)}" if dims else "")) if measures else ("distinct " * tool.distinct) + ", ".join(tool.columns)
    return f"{head} of {tool.view}" + (f" where {' and '.join(said)}" if said else "") + (f", ordered by {', '.join(order)}" if order else "") + (f", {tool.top} rows at most" if order else "")


def anchor(turns: list[dict], most: int = 5) -> dict | None:
    """The table that a follow-up is about: the newest turn with rows, unless a later turn found nothing or was of
    another kind."""
    out = None
    for turn in turns[-most:]:
        if turn.get("rows"):
            out = turn
        elif turn.get("kind") in ("not_found", "documents", "chat"):
            out = None
    return out


def storable(rows: list, database: str, restricted: set[str], most_bytes: int = 512 * 1024) -> list | None:
    """Rows that a conversation may keep: none of a restricted database, and not too many."""
    import json

    return None if database in restricted or len(json.dumps(rows, default=str).encode()) > most_bytes else rows
