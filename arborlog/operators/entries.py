"""Entry logs: decomposing tables into keyed entries, range scans and conflict resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec
from ..functions import columns as K

#: Columns of an entry log.  A tombstone has deleted = true; a null value that is not deleted is an explicit null.
LOG = "key binary, value string, deleted boolean, hlc bigint, pid bigint, commit_version bigint, seq bigint"


def decompose(df: DataFrame, node: list[Column], names: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """One (key, value) entry for each row and named column, at path node / column name; values are JSON text.

    keep: columns that go along, such as hlc and pid.
    """
    values = F.array(*(F.struct(F.lit(n).alias("name"), F.to_json(F.struct(F.col(n).alias("v")), {"ignoreNullFields": "false"}).alias("json")) for n in names))
    rows = df.select(*keep, F.concat(*node).alias("__node"), F.explode(values).alias("__x"))
    json = F.col("__x.json")
    return rows.select(*keep, K.path(F.col("__node"), K.field(F.col("__x.name")), K.lww()).alias("key"), json.substr(F.lit(6), F.length(json) - 6).alias("value"))


def sequence_entries(df: DataFrame, node: Column, array: str, pid: int) -> DataFrame:
    """Entries of the elements of an array: element i has index (pid, i + 2), as if appended one by one."""
    rows = df.select(node.alias("__node"), F.posexplode(array).alias("__i", "__v"))
    return rows.select(K.path(F.col("__node"), K.index((F.lit(pid), F.col("__i") + 2)), K.lww()).alias("key"), F.col("__v").alias("value"))


def with_prefix(df: DataFrame, prefix: bytes, key: str = "key") -> DataFrame:
    """Rows whose key has a prefix, as a range, which reaches the Parquet scan; an empty prefix is no bound."""
    if not prefix:
        return df
    end = codec.successor(prefix)
    df = df.where(F.col(key) >= F.lit(bytearray(prefix)))
    return df if end is None else df.where(F.col(key) < F.lit(bytearray(end)))


def point(df: DataFrame, key: bytes) -> DataFrame:
    return df.where(F.col("key") == F.lit(bytearray(key)))


def newest(df: DataFrame, order: list[str], key: str = "key") -> DataFrame:
    """The row of each key that is last in order; equal orders go by value, so the result does not depend on the plan."""
    rest = [c for c in df.columns if c != key and c not in order]
    last = F.max(F.struct(*order, *(F.col(c) for c in rest))).alias("__m")
    return df.groupBy(key).agg(last).select(key, *(F.col(f"__m.{c}").alias(c) for c in [*order, *rest]))


def resolve(log: DataFrame) -> DataFrame:
    """Last-write-wins registers: of each key the entry with the highest (hlc, pid), then version, then place."""
    return newest(log, ["hlc", "pid", "commit_version", "seq"])


def latest(log: DataFrame) -> DataFrame:
    """The storage rule: of each key the entry of the newest commit, whatever its clock says."""
    return newest(log, ["commit_version", "seq"])


def live(df: DataFrame) -> DataFrame:
    """Without tombstones."""
    return df.where(~F.col("deleted")).drop("deleted")


def merge_layers(*layers: DataFrame) -> DataFrame:
    """(key, value) layers, oldest first: the newest layer that has a key gives its value."""
    out = None
    for i, layer in enumerate(layers):
        layer = layer.select("key", "value", F.lit(i).alias("layer"))
        out = layer if out is None else out.unionByName(layer)
    return newest(out, ["layer"]).select("key", "value")


def counter_value(log: DataFrame, node: str = "node", value: str = "value") -> DataFrame:
    """Counters: the last value of each (node, pid) register, summed by node."""
    last = log.groupBy(node, "pid").agg(F.max(F.struct("hlc", "seq", F.col(value).alias("v"))).alias("m"))
    return last.groupBy(node).agg(F.sum("m.v").alias("total"))


def assemble_chunks(log: DataFrame, node: str = "node", value: str = "value") -> DataFrame:
    """Chunked registers: the last value of each (node, end_index), joined in the order of end_index."""
    last = log.groupBy(node, "end_index").agg(F.max(F.struct("hlc", "pid", F.col(value).alias("v"))).alias("m"))
    return last.groupBy(node).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("end_index", "m.v"))), lambda x: x["v"]), "").alias("content"))


def committed(log: DataFrame, seq: str, is_commit: Column) -> DataFrame:
    """Log records up to the last commit record: an uncommitted tail is dropped."""
    last = log.where(is_commit).agg(F.max(seq).alias("__last"))
    return log.join(F.broadcast(last), F.col(seq) <= F.col("__last")).drop("__last")


def entry_bytes(df: DataFrame) -> DataFrame:
    """(size): bytes of keys and values, each key once."""
    return df.agg(F.coalesce(F.sum(F.length("key") + F.coalesce(F.octet_length("value"), F.lit(0))), F.lit(0)).cast("long").alias("size"))


def stats(df: DataFrame) -> DataFrame:
    """(n, min_key, max_key) of a file or snapshot."""
    return df.agg(F.count("*").alias("n"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))
