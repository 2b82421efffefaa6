"""Binding a query to collections, and its DataFrame plan.

Filters are a set, applied as cursor bounds, then skip, then take; a kind given twice is an error.
``before`` alone walks backwards.  Under a parent they hold for each parent.  Keys in text cursors are
cast to the key's type; parts of a composite key are separated by ``/``.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .query_text import Filter, Query, Select


#: Numbers for the columns that join a relation to its parent.
_names = itertools.count()


#: Rows of a page at most whose keys are broadcast to the children's tasks.
FEW = 10_000


class BindError(ValueError):
    pass


@dataclass
class Collection:
    """Rows in the order of their key; relations: name -> (collection, own columns, the other's columns)."""

    df: DataFrame
    key: list[str]
    relations: dict[str, tuple[str, list[str], list[str]]] = field(default_factory=dict)


def _filter_set(filters: tuple[Filter, ...]) -> dict:
    out = {}
    for f in filters:
        if f.kind in out:
            raise BindError(f"{f.kind} is given twice")
        out[f.kind] = f.value
    return out


def _backwards(f: dict) -> bool:
    return "before" in f and "after" not in f


def _parts(value, types: list[T.DataType]) -> list[Column]:
    parts = value.split("/") if isinstance(value, str) and len(types) > 1 else [value]
    if len(parts) != len(types):
        raise BindError(f"cursor {value!r} has not the key's {len(types)} parts")
    return [F.lit(p).cast(t) for p, t in zip(parts, types)]


def _beyond(cols: list[Column], values: list[Column], after: bool) -> Column:
    """Strictly after (before) in the key's order; the first part alone bounds the scan, so it is pushed down."""
    out, equal = None, None
    for i, (c, v) in enumerate(zip(cols, values)):
        strict = c > v if after else c < v
        term = strict if equal is None else equal & strict
        out = term if out is None else out | term
        equal = (c == v) if equal is None else equal & (c == v)
    if len(cols) > 1:
        out = ((cols[0] >= values[0]) if after else (cols[0] <= values[0])) & out
    return out


def _bounded(c: Collection, df: DataFrame, f: dict) -> DataFrame:
    types = [c.df.schema[k].dataType for k in c.key]
    for kind in ("after", "before"):
        if kind in f:
            df = df.where(_beyond([F.col(k) for k in c.key], _parts(f[kind], types), kind == "after"))
    return df


def _order(c: Collection, f: dict) -> list[Column]:
    return [F.col(k).desc() if _backwards(f) else F.col(k).asc() for k in c.key]


def _page(c: Collection, f: dict) -> DataFrame:
    df = _bounded(c, c.df, f)
    if "skip" in f or "take" in f:
        if f.get("skip") and "take" not in f:
            return _beyond_first(c, df, f)
        df = df.orderBy(*_order(c, f))
        df = df.offset(f["skip"]) if f.get("skip") else df
        df = df.limit(f["take"]) if "take" in f else df
    return df


def _beyond_first(c: Collection, df: DataFrame, f: dict) -> DataFrame:
    """All but the first rows: those beyond the last key that is skipped, so no task gets all rows.

    Of rows with that very key as many go as are among the first.
    """
    first = df.select(*c.key).orderBy(*_order(c, f)).limit(f["skip"])
    last = F.struct(*c.key, "__n")
    bound = first.groupBy(*c.key).agg(F.count("*").alias("__n")).agg(F.sum("__n").alias("__skipped"), (F.min(last) if _backwards(f) else F.max(last)).alias("__last"))
    # one row
    met = df.crossJoin(F.broadcast(bound)).where(F.col("__skipped") == f["skip"])
    key, end = F.struct(*c.key), F.struct(*(F.col("__last")[k].alias(k) for k in c.key))
    beyond = met.where(key < end if _backwards(f) else key > end)
    ties = met.where(key == end).withColumn("__i", F.row_number().over(Window.partitionBy(*c.key).orderBy(*c.key))).where(F.col("__i") > F.col("__last")["__n"]).drop("__i")
    return beyond.unionByName(ties).drop("__skipped", "__last").orderBy(*_order(c, f))


def _named(selects: tuple[Select, ...]) -> None:
    names = [s.output for s in selects]
    if len(set(names)) < len(names):
        raise BindError(f"an output name stands twice among {names}")


def _keys_beyond(entries: Column, bound: Column, after: bool) -> Column:
    return F.filter(entries, lambda e: e["key"] > bound if after else e["key"] < bound)


def _nested_value(value: Column, kind: T.DataType, s: Select) -> Column:
    f = _filter_set(s.filters)
    if isinstance(kind, T.StructType):
        if f:
            raise BindError(f"{s.name} is no collection")
        if not s.selects:
            return value
        _named(s.selects)
        by_name = {x.name: x.dataType for x in kind.fields}
        for x in s.selects:
            if x.name not in by_name:
                raise BindError(f"no field {x.name} in {s.name}")
        picked = F.struct(*(_nested_value(value.getField(x.name), by_name[x.name], x).alias(x.output) for x in s.selects))
        return F.when(value.isNotNull(), picked)
    if isinstance(kind, T.ArrayType):
        if "after" in f or "before" in f:
            raise BindError("an array has no cursor keys")
        if f:
            value = F.slice(value, F.lit(f.get("skip", 0) + 1), F.lit(f.get("take", (1 << 31) - 1)))
        return F.transform(value, lambda x: _nested_value(x, kind.elementType, Select(s.name, None, (), s.selects))) if s.selects else value
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(value))
        for k in ("after", "before"):
            if k in f:
                bound = F.lit(f[k]).cast(kind.keyType)
                entries = _keys_beyond(entries, bound, k == "after")
        entries = F.reverse(entries) if _backwards(f) else entries
        if "skip" in f or "take" in f:
            entries = F.slice(entries, F.lit(f.get("skip", 0) + 1), F.lit(f.get("take", (1 << 31) - 1)))
        if s.selects:
            entries = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), _nested_value(e["value"], kind.valueType, Select(s.name, None, (), s.selects)).alias("value")))
        return entries
    if f or s.selects:
        raise BindError(f"{s.name} is neither a collection nor a struct")
    return value


class Catalog(dict):
    """name -> Collection."""

    def run(self, text: str | Query) -> dict[str, DataFrame]:
        """One DataFrame for each top-level select, in textual order; related entries are arrays of structs."""
        q = Query.parse(text) if isinstance(text, str) else text
        _named(q.selects)
        return {s.output: self._collection(s) for s in q.selects}

    def one(self, text: str | Query) -> DataFrame:
        found = self.run(text)
        if len(found) != 1:
            raise BindError("the query has not one top-level select")
        return next(iter(found.values()))

    def _get(self, name: str) -> Collection:
        if name not in self:
            raise BindError(f"no collection {name}")
        return self[name]

    def _collection(self, s: Select) -> DataFrame:
        c = self._get(s.name)
        f = _filter_set(s.filters)
        page = _page(c, f)
        return self._project(c, page, s.selects, [], bool(f), f.get("take", FEW + 1) <= FEW)

    def _project(self, c: Collection, df: DataFrame, selects: tuple[Select, ...], keep: list[str], paged: bool, few: bool = False) -> DataFrame:
        """df with the selected columns, and those in keep under their own names.

        paged: df is a part of its collection, so only its rows' children are numbered and gathered.
        few: it has FEW rows at most, so their keys are broadcast.
        """
        if not selects:
            return df
        _named(selects)
        out = []
        for s in selects:
            if s.name in c.relations:
                other, own, theirs = c.relations[s.name]
                name = f"__r{next(_names)}"
                parents = df.select(*(F.col(a).alias(f"{name}_p{j}") for j, a in enumerate(own))) if paged else None
                entries = self._entries(other, theirs, s, name, F.broadcast(parents) if few else parents)
                df = df.join(entries, [F.col(a) == F.col(f"{name}_{j}") for j, a in enumerate(own)], "left")
                out.append(F.coalesce(F.col(name), F.array().cast(entries.schema[name].dataType)).alias(s.output))
            elif s.name in df.columns:
                out.append(_nested_value(F.col(f"`{s.name}`"), df.schema[s.name].dataType, s).alias(s.output))
            else:
                raise BindError(f"no field {s.name}")
        return df.select(*(F.col(k) for k in keep), *out)

    def _entries(self, name: str, theirs: list[str], s: Select, out: str, parents: DataFrame | None) -> DataFrame:
        """For each parent (of ``parents``, if given) the ordered array of its selected entries; a null key has no parent."""
        c = self._get(name)
        f = _filter_set(s.filters)
        keys = [f"{out}_{j}" for j in range(len(theirs))]
        df = _bounded(c, c.df, f).withColumns({k: F.col(t) for k, t in zip(keys, theirs)})
        if parents is not None:
            df = df.join(parents, [F.col(k) == F.col(p) for k, p in zip(keys, parents.columns)], "left_semi")
        df = df.withColumn(f"{out}_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*_order(c, f))))
        if "skip" in f:
            df = df.where(F.col(f"{out}_n") > f["skip"])
        if "take" in f:
            df = df.where(F.col(f"{out}_n") <= f.get("skip", 0) + f["take"])
        extra = [*keys, f"{out}_n"]
        rows = self._project(c, df, s.selects, extra, bool(f) or parents is not None)
        fields = [x for x in rows.columns if x not in extra]
        rows = rows.select(*keys, F.struct(F.col(f"{out}_n"), F.struct(*(F.col(f"`{x}`") for x in fields)).alias("e")).alias("e"))
        return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["e"]).alias(out))


def flat(df: DataFrame, column: str) -> DataFrame:
    """One row for each element of an array of structs, its fields beside the parent's; none keeps the parent with nulls."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != column]
    return df.select(*rest, F.explode_outer(column).alias("__e")).select(*rest, "__e.*")
