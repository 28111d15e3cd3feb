"""Catalog searches: a plan of filters is checked against an allow-list and becomes DataFrame operations.

A plan has intent (search, clarify or unsupported; search where not given), target, filters (table, column, op and value; of a
table other than the target's own the row needs a child that meets it), text, sort and limit. One scan gives every row of
the target a flag for each filter; the rows, the outcome and the diagnosis of each filter all come from it. Children are
grouped by their key once for all filters on them, so a target never stands twice."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

OPS = ("contains", "eq", "in", "gte", "lte")
INTENTS, LIMIT, MOST = ("search", "clarify", "unsupported"), 20, 50


@dataclass
class Target:
    """A table to search: its rows, an id (or several columns that are one), its columns by kind (text, number or time), child rows
    that hold an id each, what every result must be besides, the columns that free text is looked up in, and sort orders."""

    rows: DataFrame
    key: str | list[str]
    columns: dict[str, str]
    children: dict[str, tuple[DataFrame, str | list[str], dict[str, str]]] = field(default_factory=dict)
    base: Column | None = None
    text: list[str] = field(default_factory=list)
    orders: dict[str, list[Column]] = field(default_factory=dict)

    @property
    def keys(self) -> list[str]:
        return [self.key] if isinstance(self.key, str) else list(self.key)

    def order(self, sort: str | None) -> list[Column]:
        """The sort's columns, then the key; the sort of relevance where it is unknown."""
        return [*self.orders.get(sort or "relevance", self.orders.get("relevance", [])), *self.keys]


def condition(column: str, kind: str, op: str, value) -> Column | None:
    """A filter as a column; NULL values of the table never match. None where the filter makes no sense."""
    c = F.col(column)
    if kind == "number":
        text = str(value).strip()
        if isinstance(value, bool) or not text.removeprefix("-").isdigit():
            return None
        number = int(text)
        return {"eq": c == number, "gte": c >= number, "lte": c <= number}.get(op)
    if kind == "time":
        try:
            at = F.lit(datetime.fromisoformat(str(value).strip()).isoformat()).cast("timestamp")
        except ValueError:
            return None
        return {"eq": c.cast("date") == at.cast("date"), "gte": c.cast("timestamp") >= at, "lte": c.cast("timestamp") <= at}.get(op)
    if op == "contains":
        return c.ilike(f"%{value}%")
    if op == "eq":
        return F.lower(c) == str(value).lower()
    return F.lower(c).isin([str(v).lower() for v in value]) if op == "in" else None


def _columns(target: Target, table: str | None) -> dict[str, str] | None:
    if not table:
        return target.columns
    return target.children[table][2] if table in target.children else None


def _why(f: dict, target: Target) -> str | None:
    """Why a filter can't be used; None if it can."""
    columns, value, op = _columns(target, f.get("table")), f.get("value"), f.get("op")
    if columns is None:
        return "no such table"
    if f.get("column") not in columns:
        return "no such column"
    if op not in OPS:
        return "no such operation"
    if op == "in":
        value = [v for v in value if str(v).strip()] if isinstance(value, (list, tuple)) else []
        if not value:
            return "empty list"
    elif value is None or isinstance(value, (list, tuple)) or not str(value).strip():
        return "empty value"
    kind = columns[f["column"]]
    return None if condition(f["column"], kind, op, value) is not None else f"{op} of {value!r} makes no sense for a {kind}"


def checked(plan: dict, targets: Target | dict[str, Target], most: int = MOST) -> dict:
    """The plan with what can be used of it: intent, target, filters, text, sort and limit (within 1..most), and what was dropped of
    it and why. An unknown target makes a search unsupported; one without a target, a filter or text is to be clarified."""
    named = {None: targets} if isinstance(targets, Target) else targets
    target = named.get(plan.get("target")) if not isinstance(targets, Target) else targets
    dropped, kept = [], []
    if target is None and plan.get("target"):
        dropped.append({"target": plan["target"], "why": "not a searchable table"})
    for f in plan.get("filters") or []:
        why = "no target" if target is None else _why(f, target)
        if why:
            dropped.append({"filter": f, "why": why})
        else:
            kept.append({**f, "value": [v for v in f["value"] if str(v).strip()] if f["op"] == "in" else f["value"]})
    text = str(plan.get("text") or "").strip()
    intent = plan.get("intent") if plan.get("intent") in INTENTS else "search"
    if intent == "search" and target is None:
        intent = "unsupported" if plan.get("target") else "clarify"
    try:
        limit = int(plan.get("limit") or LIMIT)
    except (TypeError, ValueError):
        limit = LIMIT
    return {"intent": intent, "target": plan.get("target"), "filters": kept, "text": text, "sort": plan.get("sort") or "relevance", "limit": min(max(limit, 1), most), "dropped": dropped}


def flagged(target: Target, filters: list[dict], text: str = "") -> tuple[DataFrame, list[str]]:
    """The target's rows (that meet its base) with a boolean column for each filter, and one for the text where there is one; and
    the names of these columns."""
    out = target.rows if target.base is None else target.rows.filter(target.base)
    taken = {c.lower() for c in out.columns}
    names = []
    for k in range(len(filters) + bool(text)):
        name = f"_meets{k}"
        while name.lower() in taken:
            name += "_"
        names.append(name)
    own = {n: condition(f["column"], target.columns[f["column"]], f["op"], f["value"]) for n, f in zip(names, filters) if not f.get("table")}
    if text:
        own[names[-1]] = reduce(Column.__or__, (F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False)) for c in target.text), F.lit(False))
    out = out.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in own.items()})
    for table in dict.fromkeys(f["table"] for f in filters if f.get("table")):
        child, key, columns = target.children[table]
        key = [key] if isinstance(key, str) else key
        of = {n: F.bool_or(F.coalesce(condition(f["column"], columns[f["column"]], f["op"], f["value"]), F.lit(False))) for n, f in zip(names, filters) if f.get("table") == table}
        met = child.groupBy(*[F.col(c).alias(k) for c, k in zip(key, target.keys, strict=True)]).agg(*[c.alias(n) for n, c in of.items()])
        out = out.join(met, target.keys, "left").withColumns({n: F.coalesce(n, F.lit(False)) for n in of})
    return out, names


def _all(names: list[str]) -> Column:
    return reduce(Column.__and__, (F.col(n) for n in names), F.lit(True))


def applied(target: Target, filters: list[dict], text: str = "") -> DataFrame:
    """The target's rows that meet all filters."""
    out, names = flagged(target, filters, text)
    return out.filter(_all(names)).select(*target.rows.columns)


def search(plan: dict, target: Target) -> DataFrame:
    good = checked(plan, target)
    out, names = flagged(target, good["filters"], good["text"])
    return out.filter(_all(names)).orderBy(*target.order(good["sort"])).limit(good["limit"]).select(*target.rows.columns)


def diagnose(plan: dict, target: Target) -> DataFrame:
    """position and n: how many rows each filter alone leaves (the text after them), and all of them (position -1)."""
    good = checked(plan, target)
    out, names = flagged(target, good["filters"], good["text"])
    counts = [F.struct(F.lit(k).alias("position"), F.count_if(c).alias("n")) for k, c in [(-1, _all(names)), *((k, F.col(n)) for k, n in enumerate(names))]]
    return out.agg(F.array(*counts).alias("c")).select(F.explode("c").alias("c")).select("c.position", "c.n")


@dataclass
class Found:
    """What a search gave: outcome (error, clarify, unsupported, none, go or choose), at most `limit` rows in order, how many rows met
    all of it, how many each filter (and then the text) alone leaves, and what was dropped of the plan."""

    outcome: str
    rows: list[Row]
    total: int
    alone: list[int]
    dropped: list[dict]


def found(plan: dict, targets: Target | dict[str, Target]) -> Found:
    """Runs a search: rows, outcome and diagnosis from one pass over the target, whose counts are observed beside the rows."""
    good = checked(plan, targets)
    if good["intent"] != "search":
        return Found(good["intent"], [], 0, [], good["dropped"])
    target = targets if isinstance(targets, Target) else targets[good["target"]]
    out, names = flagged(target, good["filters"], good["text"])
    seen = Observation()
    out = out.observe(seen, F.count_if(_all(names)).alias("total"), *[F.count_if(F.col(n)).alias(f"alone{k}") for k, n in enumerate(names)])
    rows = out.filter(_all(names)).orderBy(*target.order(good["sort"])).limit(good["limit"]).select(*target.rows.columns).collect()  # 50 rows at most
    counts = seen.get
    return Found(("none", "go", "choose")[min(2, len(rows))], rows, counts["total"], [counts[f"alone{k}"] for k in range(len(names))], good["dropped"])


def outcome(plan: dict, targets: Target | dict[str, Target]) -> str:
    """What to do with a search: clarify or unsupported as the plan says; else by its rows none, go (one) or choose."""
    return found(plan, targets).outcome
