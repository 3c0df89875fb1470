"""Deeply nested JSON records as related flat tables.

Two steps. ``merged_schema`` reads every record once and returns the union of their shapes: for each generic path (``spectra[].peaks[]``)
the kinds of value met there and how often. ``levels`` reads off it which members hold objects or lists, by member name: such a member is a
list if elements of it are objects anywhere or if it never is an object itself, otherwise a single object in whatever form. Nothing about the
record type is written down here. ``flatten`` then opens level after level: at each depth the members of all open objects are taken out, and
their elements exploded with their ordinal, as child rows that carry the path of the object above (the parent's surrogate key together with
the record's key). Every object's JSON is parsed once, in the JVM, without a shuffle. ``child_tables`` makes flat tables of the result with
the members the schema shows, ``explode_level`` those of typed columns.

A list may stand as an array, as one object, as a string that holds either, or as an object that maps keys to the elements: an object none
of whose members is known from the elements met elsewhere, and whose values are all objects, is a map of elements. Members are known if they
occur in KNOWN of the objects of that name, so that a few odd records don't change how the others are read.

Defined results: a null, blank or incomplete payload gives no rows, nor does anything behind a complete record; null elements count for the
position and give no row; null and empty objects give no row, nor does anything under them; a record without any list gives no rows; of
members written twice the last counts; a number in quotes counts as a number. Extra members are kept in the raw JSON.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KNOWN = 0.001  # share of a node's objects in which a member occurs
NAMES = 200  # members of a node that are listed; of a node with more, every member that holds an object or a list is opened
WRAPPINGS = 4


# --- schema -------------------------------------------------------------------------------------------------------------------------


def _open(value: object) -> object:
    if isinstance(value, str) and value.lstrip()[:1] in ("{", "["):
        try:
            return json.loads(value)
        except (ValueError, RecursionError):
            return value
    return value


_KINDS = {type(None): "null", bool: "boolean", int: "number", float: "number", str: "string", list: "array", dict: "object"}


class _Node:
    """What was met at a generic path: kinds with counts, and the nodes of members and elements.

    An object of two or more objects that share members is a map of elements. One of a single object may be a map of one element; its
    member is counted as unsure besides.
    """

    __slots__ = ("kinds", "members", "element")

    def __init__(self) -> None:
        self.kinds: dict[str, int] = {}
        self.members: dict[str, _Node] = {}
        self.element: _Node | None = None

    def add(self, value: object) -> None:
        stack = [(self, value)]
        while stack:
            node, v = stack.pop()
            if type(v) is str:
                v = _open(v)
            kind = _KINDS[type(v)]
            node.kinds[kind] = node.kinds.get(kind, 0) + 1
            if kind == "array":
                if v and node.element is None:
                    node.element = _Node()
                stack.extend((node.element, x) for x in v)
            elif kind == "object":
                values = [x for x in v.values() if x is not None]
                alike = bool(values) and all(type(x) is dict for x in values)
                if alike and len(values) > 1 and set.intersection(*map(set, values)):  # a map of elements
                    if node.element is None:
                        node.element = _Node()
                    stack.extend((node.element, x) for x in v.values())
                    continue
                for k, x in v.items():
                    below = node.members.get(k)
                    if below is None:
                        below = node.members[k] = _Node()
                    if alike and len(values) == 1:
                        below.kinds["unsure"] = below.kinds.get("unsure", 0) + 1
                    stack.append((below, x))

    def rows(self, name: str = "$", depth: int = 0, path: str = "$", holder: str = "") -> Iterator[tuple]:
        for kind, n in self.kinds.items():
            yield path, holder, name, depth, kind, n
        if self.element is not None:
            yield from self.element.rows(name + "[]", depth, path + "[]", holder)
        for k, node in self.members.items():
            yield from node.rows(k, depth + 1, f"{path}.{k}", name.removesuffix("[]"))


def _record(value: object, mark: str = "source_filename") -> object:
    """The record inside its wrappings: a list of one record, or an object with the record as a member."""
    for _ in range(WRAPPINGS):
        if isinstance(value, list) and len(value) == 1:
            value = value[0]
        elif isinstance(value, dict) and mark not in value and len(value) == 1:
            value = _open(next(iter(value.values())))
        else:
            break
    return value


def _shapes(df: DataFrame, column: str) -> DataFrame:
    """Rows (path, holder, name, depth, kind, n); holder and name are member names, name with [] for elements."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64())
        for batch in batches:
            root = _Node()
            for text in batch.column(0).to_pylist():
                if text is not None:
                    try:
                        value = _record(json.loads(text))
                    except (ValueError, RecursionError):
                        continue
                    if isinstance(value, dict):
                        root.add(value)
            rows = list(root.rows())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["path", "holder", "name", "depth", "kind", "n"])

    seen = df.select(F.col(column).cast("string")).mapInArrow(scan, "path string, holder string, name string, depth int, kind string, n bigint")
    return seen.groupBy("path", "holder", "name", "depth", "kind").agg(F.sum("n").alias("n"))


def merged_schema(df: DataFrame, column: str) -> DataFrame:
    """Rows (path, kind, n): every generic path of the column's JSON values, the kinds of value there and how often each.

    Each batch is summed up before anything is shuffled.
    """
    return _shapes(df, column).filter("kind != 'unsure'").groupBy("path", "kind").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Level:
    """A member that holds objects or a list. numbers, texts: bare ones are elements too; texts only in a list without objects."""

    single: bool
    numbers: bool
    texts: bool


@dataclass(frozen=True)
class Levels:
    """The levels by member name; which of them each node has ($ is the record; None: all); the members known of each, with whether they
    are numbers; the greatest depth."""

    kinds: dict[str, Level]
    under: dict[str, frozenset[str] | None]
    known: dict[str, dict[str, bool]]
    depth: int


def levels(df: DataFrame, column: str, lists: tuple[str, ...] = ()) -> Levels:
    """The levels of a column's records. What comes to the driver is bounded by NAMES and 1 / KNOWN for each node name, whatever the rows.

    lists: names of members that are lists even where the table has single objects only.
    """
    base = F.regexp_replace("name", r"(\[\])+$", "")
    held = _shapes(df, column).select("holder", base.alias("base"), F.col("name").endswith("[]").alias("element"), "kind", "n", "depth")
    n, element, is_ = F.col("n"), F.col("element"), lambda *kinds: F.col("kind").isin(*kinds)
    total = lambda c: F.sum(F.when(c, n).otherwise(0))
    pairs = held.groupBy("holder", "base").agg(
        F.max(is_("object", "array") | element).alias("level"), (total(~element & ~is_("unsure")) - total(is_("unsure"))).alias("sure"), total(is_("number")).alias("number"),
        total(is_("string", "boolean")).alias("text"), total(~is_("unsure") & ~element).alias("n"), total(is_("object")).alias("all"), F.max(F.when(is_("object", "array"), F.col("depth"))).alias("depth"),
        F.max(element & is_("object")).alias("objects"), F.max(~element & is_("object")).alias("alone"), F.max(element & is_("number")).alias("numbers"), F.max(element & is_("string")).alias("texts"),
    ).persist()
    try:
        # an unsure member is the key of a map if its object has members that the holder's elements have
        inner = pairs.select(F.col("holder").alias("base"), F.col("base").alias("inner"))
        proper = pairs.filter("sure > 0 and base != '$'").select("holder", F.col("base").alias("inner"))
        keys = pairs.filter("sure <= 0").select("holder", "base").join(inner, "base").join(proper, ["holder", "inner"]).select("holder", "base").distinct()
        real = pairs.join(keys, ["holder", "base"], "left_anti").join(keys.select(F.col("base").alias("holder")), "holder", "left_anti")
        most = max(NAMES + 1, ceil(1 / KNOWN))
        order = Window.partitionBy("holder").orderBy(F.desc("level"), F.desc("n"), "base")
        rows = real.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= most).collect()
    finally:
        pairs.unpersist()
    objects: dict[str, int] = {}
    for r in rows:
        objects[r["base"]] = objects.get(r["base"], 0) + r["all"]
    under: dict[str, frozenset[str] | None] = {}
    known: dict[str, dict[str, bool]] = {}
    flags: dict[str, dict[str, bool]] = {}
    depth = 0
    for r in rows:
        holder, name = r["holder"], r["base"]
        if name == "$":
            continue
        if r["level"]:
            under[holder] = (under.get(holder) or frozenset()) | {name}
            depth = max(depth, r["depth"] or 0)
            mine = flags.setdefault(name, {})
            for f in ("objects", "alone", "numbers", "texts"):
                mine[f] = mine.get(f, False) or bool(r[f])
        if r["n"] >= KNOWN * objects.get(holder, 0):
            known.setdefault(holder, {})[name] = r["number"] > r["text"]
    kinds = {n: Level(f["alone"] and not f["objects"] and n not in lists, f["numbers"], f["texts"] and not f["objects"]) for n, f in flags.items()}
    under = {h: None if names and len(names) > NAMES else names for h, names in under.items()}
    return Levels(kinds, under, known, depth)


# --- flattening ---------------------------------------------------------------------------------------------------------------------

_STRICT = {"allowSingleQuotes": "false"}
_BAD = "\u0000bad"


def _as_map(raw: Column) -> Column:
    return F.from_json(raw, "map<string,string>", _STRICT)


def _as_list(raw: Column) -> Column:
    return F.from_json(raw, "array<string>", _STRICT)


def _begins(raw: Column, mark: str) -> Column:
    return F.ltrim(raw).startswith(mark)


def singular(name: str) -> str:
    """The name of an element of a list."""
    for plural, one in (("ies", "y"), ("tra", "trum"), ("ss", "ss"), ("s", "")):
        if name.endswith(plural):
            return name[: len(name) - len(plural)] + one
    return name


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), an array, for a value that isn't null, which is computed once; else an empty array."""
    return F.flatten(F.transform(F.filter(F.array(value), lambda x: x.isNotNull()), then))


def _records(df: DataFrame, key: str, column: str, mark: str) -> DataFrame:
    """Rows (key, raw): the complete records without their wrappings."""
    text = F.col(column).cast("string")
    rows = df.select(F.col(key), text.alias("raw")).filter(F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1)  # complete JSON, and nothing behind it
    plain = rf'^\s*\{{\s*"{re.escape(mark)}"\s*:'  # the usual form needs no look into it
    for _ in range(WRAPPINGS):
        inner = F.when(_begins(F.col("raw"), "["), _once(_as_list(F.col("raw")), lambda a: F.when(F.size(a) == 1, a).otherwise(F.slice(a, 1, 0)))).otherwise(
            _once(_as_map(F.col("raw")), lambda m: F.when((F.size(m) == 1) & ~F.map_contains_key(m, F.lit(mark)), F.map_values(m)).otherwise(F.array(F.col("raw"))))
        )
        # outer forms throughout: the plain ones make the optimizer filter by the array, and so parse everything twice
        rows = rows.select(F.col(key), F.explode_outer(F.when(F.col("raw").rlike(plain), F.array("raw")).otherwise(inner)).alias("raw"))
    return rows.filter(_begins(F.col("raw"), "{"))


def _elements(member: Column, value: Column, lv: Levels) -> Column:
    """The elements of a member in the order written, in whatever form they stand."""
    names = sorted(lv.kinds)
    single = [n for n in names if lv.kinds[n].single]
    known = F.lit(False)
    parts = [(n, sorted(lv.known.get(n, ()))) for n in names if not lv.kinds[n].single]

    def of_map(m: Column) -> Column:
        has = known
        for n, mine in parts:
            has = has | ((member == n) & F.arrays_overlap(F.map_keys(m), F.array(*map(F.lit, mine)))) if mine else has
        keyed = (F.size(m) > 0) & F.forall(F.map_values(m), lambda x: x.isNull() | _begins(x, "{")) & ~has
        return F.when(keyed, F.map_values(m)).otherwise(F.array(value))

    whole = F.when(F.trim(value).rlike(r"^(?:\[\s*\]|\{\s*\})?$"), F.array().cast("array<string>")).otherwise(F.array(value))
    return (
        F.when(value.isNull(), F.array().cast("array<string>"))
        .when(member.isin(*single) if single else F.lit(False), whole)
        .when(_begins(value, "["), _once(_as_list(value), lambda a: a))
        .when(_begins(value, "{"), _once(_as_map(value), of_map))
        .otherwise(F.array().cast("array<string>"))
    )


def _is_case(member: Column, item: Column, lv: Levels) -> Column:
    def of(flag: str) -> Column:
        names = [n for n, x in sorted(lv.kinds.items()) if getattr(x, flag)]
        return member.isin(*names) if names else F.lit(False)

    whole = item.rlike(r"(?s)^\s*\{\s*[^\s}].*\}\s*$")
    return of("single") | whole | (of("numbers") & item.try_cast("double").isNotNull()) | (of("texts") & item.rlike(r"\S") & ~_begins(item, "{"))


def flatten(df: DataFrame, key: str, column: str, lv: Levels | None = None, raw: bool = True, lists: tuple[str, ...] = (), mark: str = "source_filename") -> DataFrame:
    """Rows (key, parent, child, pos, path, raw): every object of the levels in every record.

    path is the object's own path, unique within a record, so (key, path) is the surrogate key and (key, parent) points to the parent row.
    lv: what ``levels`` gives; it is computed here, with lists, if missing. raw=False leaves out the object's JSON. mark: a member of every
    record itself.
    """
    if lv is None:
        lv = levels(df, column, lists)
    rows = _records(df, key, column, mark).select(
        F.col(key), F.lit("").alias("parent"), F.lit("$").alias("member"), F.lit(0).alias("pos"), F.lit("").alias("path"), "raw", F.lit(True).alias("open")
    )
    opened = [n for n in sorted(lv.under) if n == "$" or n in lv.kinds]

    line = F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("value"))

    def taken(node: str, raw: Column) -> Column:
        """The object itself, as a line without a name, and its members that are levels; nothing of what isn't an object."""
        names = lv.under[node]
        if names is None:
            every = lambda m: F.concat(F.array(line), F.transform(F.filter(F.map_entries(m), lambda e: e["value"].isNotNull()), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value"))))
            return _once(_as_map(raw), every)
        # a struct of the members wanted: the parser skips the others
        kind = T.StructType([*(T.StructField(n, T.StringType()) for n in sorted(names)), T.StructField(_BAD, T.StringType())])
        members = lambda p: F.array(line, *(F.struct(F.lit(n).alias("name"), p[n].alias("value")) for n in sorted(names)))
        kept = lambda p: F.when(p[_BAD].isNull(), F.filter(members(p), lambda e: e["name"].isNull() | e["value"].isNotNull())).otherwise(F.slice(F.array(line), 1, 0))
        return _once(F.from_json(raw, kind, {**_STRICT, "columnNameOfCorruptRecord": _BAD}), kept)

    for _ in range(lv.depth):
        if not opened:
            break
        member, value = F.col("member"), F.col("raw")
        parts = F.array(line)
        for n in opened:
            parts = F.when(F.col("open") & (member == n), taken(n, value)).otherwise(parts)
        members = rows.withColumn("__m", F.explode_outer(parts)).filter("__m is not null").select(
            key, "parent", "member", "pos", "path", F.when(F.col("__m.name").isNull(), F.col("raw")).alias("raw") if raw else F.lit(None).cast("string").alias("raw"),
            F.when(F.col("__m.name").isNull(), False).alias("self"), F.col("__m.name").alias("name"), F.col("__m.value").alias("value"),
        )
        items = F.when(F.col("name").isNull(), F.array(F.col("raw"))).otherwise(_elements(F.col("name"), F.col("value"), lv))
        exploded = members.select("*", F.posexplode_outer(items).alias("__pos", "__item"))
        fresh = F.col("name").isNotNull()
        stem = F.concat(F.when(F.col("path") != "", F.concat("path", F.lit("."))).otherwise(F.lit("")), "name")
        single = [n for n, x in sorted(lv.kinds.items()) if x.single]
        own = F.when(F.col("name").isin(*single) if single else F.lit(False), stem).otherwise(F.concat(stem, F.lit("["), F.col("__pos").cast("string"), F.lit("]")))
        rows = exploded.filter(~fresh | (F.col("__item").isNotNull() & _is_case(F.col("name"), F.col("__item"), lv))).select(
            key,
            F.when(fresh, F.col("path")).otherwise(F.col("parent")).alias("parent"),
            F.when(fresh, F.col("name")).otherwise(F.col("member")).alias("member"),
            F.when(fresh, F.col("__pos")).otherwise(F.col("pos")).alias("pos"),
            F.when(fresh, own).otherwise(F.col("path")).alias("path"),
            F.col("__item").alias("raw"),
            (fresh & _begins(F.col("__item"), "{")).alias("open"),
        )
    child = F.element_at(F.create_map(*(F.lit(x) for n in sorted(lv.kinds) for x in (n, singular(n)))), F.col("member")) if lv.kinds else F.col("member")
    out = rows.filter(F.col("member") != "$").select(key, "parent", child.alias("child"), F.col("pos").cast("bigint").alias("pos"), "path", "raw")
    return out if raw else out.drop("raw")


def child_tables(flat: DataFrame, key: str, lv: Levels, bare: dict[str, str] | None = None, numbers: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Typed flat tables of the objects, one for each level, each with (key, path) and the parent's path, and the members known of it.

    bare: by level the column that takes an element that isn't an object; else it is value. Levels of such elements only have just that.
    numbers: members that are read as numbers even where most stand in quotes. Clashing names get an underscore.
    """
    out = {}
    for name, level in lv.kinds.items():
        members = {n: number for n, number in sorted(lv.known.get(name, {}).items()) if n not in lv.kinds}
        rows = flat.filter(F.col("child") == singular(name)).select(key, "parent", "path", "pos", "raw", _as_map(F.col("raw")).alias("__m"))
        columns = {}
        for n, number in members.items():
            c = F.element_at("__m", F.lit(n))
            columns[n + "_" * (n in (key, "parent", "path", "pos"))] = c.try_cast("double") if number or n in numbers else c
        if level.numbers or level.texts:
            own = (bare or {}).get(singular(name), "value")
            whole = F.when(F.col("__m").isNull(), F.col("raw"))
            whole = whole.try_cast("double") if level.numbers and not level.texts else whole
            columns[own] = F.coalesce(columns[own], whole) if own in columns else whole
        out[singular(name)] = rows.select(key, "parent", "path", "pos", *(c.alias(n) for n, c in columns.items()))
    return out


def explode_level(df: DataFrame, keys: list[str], column: str, ordinal: str = "pos", outer: bool = False) -> DataFrame:
    """One row for each element of a typed array column, with the keys and the ordinal (from 0); struct members become columns.

    Null and empty arrays give no row (outer: one row of nulls); null elements keep their position. Members whose names clash with a key
    get the column's name as a prefix.
    """
    gen: Callable[[str], Column] = F.posexplode_outer if outer else F.posexplode
    rows = df.select(*keys, gen(F.col(column)).alias(ordinal, "__e"))
    kind = rows.schema["__e"].dataType
    if not isinstance(kind, T.StructType):
        return rows.withColumnRenamed("__e", column if column not in keys else f"{column}_value").withColumn(ordinal, F.col(ordinal).cast("bigint"))
    taken = {*keys, ordinal}
    return rows.select(*keys, F.col(ordinal).cast("bigint").alias(ordinal), *(F.col(f"__e.{f.name}").alias(f.name if f.name not in taken else f"{column}_{f.name}") for f in kind.fields))
