"""Every query of the engine by name, with its DuckDB equivalent.  Keys are shown as upper-case hex."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clock, codec
from ..functions import columns as K
from ..operators import entries as E
from ..operators.mutation import DELETE, Assign, entries, mutation
from ..sources.store import Options, Store, WriterBusy
from .binder import BindError, Catalog, Collection, flat
from .query_text import Query, QueryError, select
from .query_text import query as tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The tables as collections, in the order of their keys, with their relations."""
    t = lambda name: _table(spark, sf_dir, name)
    events = t("events").withColumn("props", F.from_json("props", "k bigint"))
    return Catalog(
        region=Collection(t("region"), ["r_regionkey"], {"nations": ("nation", ["r_regionkey"], ["n_regionkey"])}),
        nation=Collection(t("nation"), ["n_nationkey"], {"customers": ("customer", ["n_nationkey"], ["c_nationkey"])}),
        customer=Collection(t("customer"), ["c_custkey"], {"orders": ("orders", ["c_custkey"], ["o_custkey"])}),
        part=Collection(t("part"), ["p_partkey"]),
        orders=Collection(t("orders"), ["o_orderkey"], {"lines": ("lineitem", ["o_orderkey"], ["l_orderkey"])}),
        lineitem=Collection(t("lineitem"), ["l_orderkey", "l_linenumber"]),
        events=Collection(events, ["event_id"]),
        embeddings=Collection(t("embeddings"), ["vec_id"]),
    )


def _run(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: catalog(spark, sf_dir).one(text)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "{ customer(skip: 1, take: 10) { c_custkey as id, c_name as name, orders(take: 3) { o_orderkey } } }"
    return flat(catalog(spark, sf_dir).one(text), "orders")


query("""WITH c AS (SELECT * FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 1),
o AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3)
SELECT c_custkey AS id, c_name AS name, o_orderkey FROM c LEFT JOIN o ON o_custkey = c_custkey""")(flagship)


def _text_query(name: str, text: str, sql: str, flatten: tuple[str, ...] = ()) -> None:
    def f(spark, sf_dir):
        df = _run(text)(spark, sf_dir)
        for column in flatten:
            df = flat(df, column)
        return df

    f.__name__, f.__doc__ = name, text
    query(sql)(f)


_text_query("select_fields", "{ customer { c_custkey c_name, c_acctbal } }", "SELECT c_custkey, c_name, c_acctbal FROM customer")
_text_query("select_alias", "{ part { p_partkey as id, p_brand as brand, p_size as as } }", 'SELECT p_partkey AS id, p_brand AS brand, p_size AS "as" FROM part')
_text_query("select_quoted_alias", '{ nation { "n_nationkey" as "the key", n_name as "display name" } }', 'SELECT n_nationkey AS "the key", n_name AS "display name" FROM nation')
_text_query("nested_relation", "{ customer { c_custkey, orders { o_orderkey, o_totalprice as total } } }", "SELECT c_custkey, o_orderkey, o_totalprice AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey", ("orders",))
_text_query(
    "deep_nested_relation",
    "{ region { r_name, nations { n_name, customers(take: 5) { c_custkey, orders(skip: 1, take: 2) { o_orderkey } } } } }",
    """WITH c AS (SELECT * FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) <= 5),
o AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) BETWEEN 2 AND 3)
SELECT r_name, n_name, c_custkey, o_orderkey FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN c ON c_nationkey = n_nationkey LEFT JOIN o ON o_custkey = c_custkey""",
    ("nations", "customers", "orders"),
)
_text_query("page_skip_take", "{ orders(skip: 100, take: 50) { o_orderkey, o_totalprice } }", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
_text_query("page_take_zero", "{ orders(take: 0) { o_orderkey } }", "SELECT o_orderkey FROM orders WHERE false")
_text_query("page_skip_only", "{ customer(skip: 100) { c_custkey } }", "SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 100")
_text_query("page_per_parent", "{ customer { c_custkey, orders(skip: 1, take: 10) { o_orderkey } } }", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) BETWEEN 2 AND 11) ON o_custkey = c_custkey", ("orders",))
_text_query("cursor_after", '{ orders(after: "1000", take: 20) { o_orderkey, o_custkey } }', "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 20")
_text_query("cursor_before", '{ orders(before: "1000", take: 20) { o_orderkey, o_custkey } }', "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey < 1000 ORDER BY o_orderkey DESC LIMIT 20")
_text_query("cursor_range", '{ lineitem(after: "100/2", before: "200/1", skip: 3) { l_orderkey, l_linenumber } }', "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey > 100 OR l_orderkey = 100 AND l_linenumber > 2) AND (l_orderkey < 200 OR l_orderkey = 200 AND l_linenumber < 1) ORDER BY 1, 2 OFFSET 3")
_text_query("cursor_per_parent", '{ customer { c_custkey, orders(after: "2000", before: "9000", take: 2) { o_orderkey } } }', "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderkey > 2000 AND o_orderkey < 9000 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 2) ON o_custkey = c_custkey", ("orders",))


@query("SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def nested_struct(spark, sf_dir):
    df = catalog(spark, sf_dir).one("{ events { event_id as id, props as p { k } } }")
    return df.select("id", "p.k")


@query("SELECT vec_id, p - 1 AS place, embedding[p]::DOUBLE AS x FROM (SELECT vec_id, embedding, unnest(range(3, 6)) AS p FROM embeddings)")
def array_page(spark, sf_dir):
    df = catalog(spark, sf_dir).one("{ embeddings { vec_id, embedding(skip: 2, take: 3) } }")
    return df.select("vec_id", F.posexplode("embedding").alias("p", "v")).select("vec_id", (F.col("p") + 2).cast("long").alias("place"), F.col("v").cast("double").alias("x"))


@query("SELECT 'user' AS source, event_type AS key, count(*) AS n FROM events GROUP BY 2 HAVING event_type > 'click' ORDER BY 2 LIMIT 2")
def map_page(spark, sf_dir):
    counts = _table(spark, sf_dir, "events").groupBy("event_type").count()
    one = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "count")))).alias("types")).withColumn("id", F.lit(1))
    df = Catalog(users=Collection(one, ["id"])).one('{ users { types(after: "click", take: 2) } }')
    return df.select(F.lit("user").alias("source"), F.explode("types").alias("e")).select("source", "e.key", F.col("e.value").alias("n"))


_HEX_VARINT = "CASE WHEN {x} = 0 THEN '00' ELSE printf('%02X', (length(printf('%x', {x})) + 1) // 2) || CASE WHEN length(printf('%x', {x})) % 2 = 1 THEN '0' ELSE '' END || upper(printf('%x', {x})) END"


def _v(x: str) -> str:
    return _HEX_VARINT.format(x=x)


@query(f"SELECT conv_id, string_agg({_v('1')} || {_v('place')}, '-' ORDER BY place) AS indices, count(*) AS n FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) + 1 AS place FROM conversations) GROUP BY 1")
def transcript_sequence(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    rows = turns.select("conv_id", F.posexplode("turns").alias("i", "turn")).select("conv_id", "i", F.hex(F.concat(K.varint_col(F.lit(1)), K.varint_col(F.col("i") + 2))).alias("h"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]), "-").alias("indices"), F.count("*").alias("n"))


@query("SELECT c_custkey, '00' || hex('customer') || '00' || hex(CAST(c_custkey AS VARCHAR)) || '00' || hex('c_name') || '001E' AS key FROM customer")
def path_encode_lww(spark, sf_dir):
    key = K.path(K.field(F.lit("customer")), K.field(F.col("c_custkey").cast("string")), K.field(F.lit("c_name")), K.lww())
    return _table(spark, sf_dir, "customer").select("c_custkey", F.hex(key).alias("key"))


@query(f"SELECT conv_id, turn, '00' || hex(CAST(conv_id AS VARCHAR)) || '00' || {_v('1')} || {_v('(turn + 2)')} || '001E' AS key FROM conversations")
def path_encode_index(spark, sf_dir):
    key = K.path(K.field(F.col("conv_id").cast("string")), K.index((F.lit(1), F.col("turn") + 2)), K.lww())
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.hex(key).alias("key"))


@query(f"SELECT doc_id, '00' || hex('content') || '001F' || {_v('n_chars')} AS key FROM documents")
def path_encode_chunked(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.hex(K.path(K.field(F.lit("content")), K.chunked(F.col("n_chars")))).alias("key"))


@query("SELECT event_id, '00' || hex(event_type) || '001D' || printf('%08X', user_id + 1) AS key FROM events")
def path_encode_counter(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", F.hex(K.path(K.field(F.col("event_type")), K.counter(F.col("user_id") + 1))).alias("key"))


@query(f"SELECT DISTINCT n, {_v('n')} AS bytes FROM (SELECT l_partkey AS n FROM lineitem UNION ALL SELECT unnest([0, 1, 255, 256, 65536, 4294967295, 9223372036854775807]))")
def varint_encode(spark, sf_dir):
    edge = spark.createDataFrame([(n,) for n in (0, 1, 255, 256, 65536, (1 << 32) - 1, (1 << 63) - 1)], "n long")
    return _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("n")).union(edge).distinct().select("n", F.hex(K.varint_col(F.col("n"))).alias("bytes"))


@query("SELECT DISTINCT l_partkey AS n, l_partkey AS back FROM lineitem")
def varint_decode(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("n")).distinct().select("n", K.read_varint_col(K.varint_col(F.col("n"))).alias("back"))


@query("SELECT doc_id, NOT regexp_matches(text, '[\\x00-\\x1f]') AS valid FROM documents")
def field_validate(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", K.valid_field(F.col("text")).alias("valid"))


@query("SELECT doc_id, octet_length(encode(text)) + 3 <= 32767 AS within FROM documents")
def path_length_limit(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", K.within_limit(F.concat(K.raw_field(F.col("text")), K.lww())).alias("within"))


@query("SELECT 6 AS segments, 'lww' AS term, count(*) AS n FROM conversations")
def path_decode(spark, sf_dir):
    key = K.path(*(K.field(F.lit(x)) for x in ("c", "", "é")), K.field(F.col("conv_id").cast("string")), K.index((F.lit(1), F.col("turn") + 2), (F.lit(7), F.col("turn"))), K.field(F.col("role")), K.lww())
    rows = _table(spark, sf_dir, "conversations").select(K.decode_path_col(key).alias("p"), "role", "turn")
    good = rows.where((F.element_at("p.segments", -1)["field"] == F.col("role")) & (K.index_segments_col(F.element_at("p.segments", -2)["index"])[0]["seq"] == F.col("turn") + 2))
    return good.groupBy(F.size("p.segments").alias("segments"), F.col("p.term.kind").alias("term")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, printf('(3@%d):(1@2)', turn + 2) AS shown FROM conversations")
def index_between(spark, sf_dir):
    low = F.concat(K.varint_col(F.lit(3)), K.varint_col(F.col("turn") + 2))
    high = F.concat(K.varint_col(F.lit(3)), K.varint_col(F.col("turn") + 3))
    made = K.index_between_col(low, high, F.lit(1))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", K.show_index_col(K.index_segments_col(made)).alias("shown"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def cbor_round_trip(spark, sf_dir):
    back = K.cbor_to_json(K.json_to_cbor(F.col("props")))
    return _table(spark, sf_dir, "events").select("event_id", F.get_json_object(back, "$.k").cast("long").alias("k"))


def _entries(spark, sf_dir, table: str, key: str, names: list[str]) -> DataFrame:
    return E.decompose(_table(spark, sf_dir, table), [K.field(F.lit(table)), K.field(F.col(key).cast("string"))], names)


def _entries_sql(table: str, key: str, names: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '00' || hex('{table}') || '00' || hex(CAST({key} AS VARCHAR)) || '00' || hex('{n}') || '001E' AS key, {x} AS value FROM {table}" for n, x in names.items())


def _text(c: str) -> str:
    return f"'\"' || {c} || '\"'"


def _number(c: str) -> str:
    return f"CAST({c} AS VARCHAR)"


_REGION = _entries_sql("region", "r_regionkey", {"r_regionkey": _number("r_regionkey"), "r_name": _text("r_name")})
_NATION = _entries_sql("nation", "n_nationkey", {"n_name": _text("n_name"), "n_regionkey": _number("n_regionkey")})
_CUSTOMER = _entries_sql("customer", "c_custkey", {"c_name": _text("c_name"), "c_mktsegment": _text("c_mktsegment"), "c_nationkey": _number("c_nationkey")})
_TURNS = "SELECT '00' || hex('conversations') || '00' || hex(CAST(conv_id AS VARCHAR)) || '00' || hex(printf('%04d', turn)) || '001E' AS key, text AS value FROM conversations"


def _region(spark, sf_dir):
    return _entries(spark, sf_dir, "region", "r_regionkey", ["r_regionkey", "r_name"])


def _nation(spark, sf_dir):
    return _entries(spark, sf_dir, "nation", "n_nationkey", ["n_name", "n_regionkey"])


def _customer(spark, sf_dir):
    return _entries(spark, sf_dir, "customer", "c_custkey", ["c_name", "c_mktsegment", "c_nationkey"])


def _turns(spark, sf_dir):
    key = K.path(K.field(F.lit("conversations")), K.field(F.col("conv_id").cast("string")), K.field(F.lpad(F.col("turn").cast("string"), 4, "0")), K.lww())
    return _table(spark, sf_dir, "conversations").select(key.alias("key"), F.col("text").alias("value"))


def _shown(df: DataFrame) -> DataFrame:
    return df.select(F.hex("key").alias("key"), "value")


@query(f"{_REGION} UNION ALL {_NATION} UNION ALL {_CUSTOMER}")
def decompose_rows(spark, sf_dir):
    return _shown(_region(spark, sf_dir).union(_nation(spark, sf_dir)).union(_customer(spark, sf_dir)))


@query("SELECT '00' || hex('customer') || '00' || hex('77') || '00' || hex('c_name') || '001E' AS key, '\"' || c_name || '\"' AS value FROM customer WHERE c_custkey = 77")
def point_get(spark, sf_dir):
    return _shown(E.point(_entries(spark, sf_dir, "customer", "c_custkey", ["c_name", "c_mktsegment"]), codec.encode_path(["customer", "77", "c_name"])))


@query(f"SELECT * FROM ({_TURNS}) WHERE starts_with(key, '00' || hex('conversations') || '00' || hex('1') || '00')")
def prefix_scan(spark, sf_dir):
    return _shown(E.with_prefix(_turns(spark, sf_dir), codec.subtree(["conversations", "1"])))


@query(_CUSTOMER)
def full_scan(spark, sf_dir):
    return _shown(E.with_prefix(_customer(spark, sf_dir), b"").orderBy("key"))


def _layers(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    # a base of all orders, and two overlays of some of its keys
    layer = lambda cond, value: orders.where(cond).select(K.path(K.field(F.lit("orders")), K.field(F.col("o_orderkey").cast("string")), K.lww()).alias("key"), value.alias("value"))
    return layer("true", F.col("o_orderstatus")), layer("o_orderkey % 2 = 0", F.lit("new")), layer("o_orderkey % 5 = 0", F.lit("staged"))


_ORDER_KEY = "'00' || hex('orders') || '00' || hex(CAST(o_orderkey AS VARCHAR)) || '001E'"


@query(f"SELECT {_ORDER_KEY} AS key, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE o_orderstatus END AS value FROM orders")
def layer_merge(spark, sf_dir):
    base, overlay, _ = _layers(spark, sf_dir)
    return _shown(E.merge_layers(base, overlay))


@query(f"SELECT {_ORDER_KEY} AS key, CASE WHEN o_orderkey % 5 = 0 THEN 'staged' WHEN o_orderkey % 2 = 0 THEN 'new' ELSE o_orderstatus END AS value FROM orders")
def read_your_writes(spark, sf_dir):
    return _shown(E.merge_layers(*_layers(spark, sf_dir)))


def _registers(spark, sf_dir, deletes: bool = False, bound: int | None = None):
    events = _table(spark, sf_dir, "events")
    log = events.select(
        K.path(K.field(F.col("user_id").cast("string")), K.field(F.lit("value")) if deletes else K.field(F.col("event_type")), K.lww()).alias("key"),
        F.when((F.col("event_type") != "error") | F.lit(not deletes), F.col("value").cast("string")).alias("value"),
        ((F.col("event_type") == "error") & F.lit(deletes)).alias("deleted"),
        clock.hlc_of(F.col("ts")).alias("hlc"),
        (F.col("event_id") + 1).alias("pid"),
        F.floor(F.col("event_id") / 1000).cast("long").alias("commit_version"),
        F.col("event_id").alias("seq"),
    )
    return log if bound is None else log.where(F.col("commit_version") <= bound)


_HLC = "((epoch_us(ts) // 1000) & ~255)"
_REGISTER = "'00' || hex(CAST(user_id AS VARCHAR)) || '00' || hex(event_type) || '001E'"
_RESULT = "key, round(value, 6) AS value"


def _as_number(df: DataFrame) -> DataFrame:
    return df.select(F.hex("key").alias("key"), F.round(F.col("value").cast("double"), 6).alias("value"))


@query(f"SELECT {_RESULT} FROM (SELECT {_REGISTER} AS key, arg_max(value, ({_HLC}, event_id + 1)) AS value FROM events GROUP BY 1)")
def lww_resolve(spark, sf_dir):
    return _as_number(E.resolve(_registers(spark, sf_dir)))


@query(f"SELECT {_RESULT} FROM (SELECT '00' || hex(CAST(user_id AS VARCHAR)) || '00' || hex('value') || '001E' AS key, arg_max(value, ({_HLC}, event_id + 1)) AS value, arg_max(event_type, ({_HLC}, event_id + 1)) AS t FROM events GROUP BY 1) WHERE t <> 'error'")
def lww_tombstone(spark, sf_dir):
    return _as_number(E.live(E.resolve(_registers(spark, sf_dir, deletes=True))))


@query(f"SELECT {_RESULT} FROM (SELECT {_REGISTER} AS key, arg_max(value, event_id) AS value FROM events GROUP BY 1)")
def storage_rule(spark, sf_dir):
    return _as_number(E.latest(_registers(spark, sf_dir)))


@query(f"SELECT {_RESULT} FROM (SELECT {_REGISTER} AS key, arg_max(value, event_id) AS value FROM events WHERE event_id // 1000 <= 3 GROUP BY 1)")
def snapshot_as_of(spark, sf_dir):
    return _as_number(E.latest(_registers(spark, sf_dir, bound=3)))


@query(f"SELECT event_type AS node, round(sum(value), 4) AS total FROM (SELECT event_type, user_id, arg_max(value, ({_HLC}, event_id)) AS value FROM events GROUP BY 1, 2) GROUP BY 1")
def counter_sum(spark, sf_dir):
    log = _table(spark, sf_dir, "events").select(F.col("event_type").alias("node"), (F.col("user_id") + 1).alias("pid"), clock.hlc_of(F.col("ts")).alias("hlc"), F.col("event_id").alias("seq"), "value")
    return E.counter_value(log).select("node", F.round("total", 4).alias("total"))


@query("SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def chunk_assemble(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("node"), F.col("turn").alias("end_index"), F.lit(0).alias("hlc"), F.lit(1).alias("pid"), F.col("text").alias("value"))
    return E.assemble_chunks(turns).select(F.col("node").alias("conv_id"), F.md5(F.col("content").cast("binary")).alias("digest"))


@query(f"SELECT event_id, {_HLC} AS hlc FROM events")
def hlc_mask(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", clock.hlc_of(F.col("ts")).alias("hlc"))


@query(f"SELECT event_id, strftime(make_timestamp({_HLC} * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS shown FROM events")
def hlc_to_time(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", clock.show_hlc(clock.hlc_of(F.col("ts"))).alias("shown"))


@query("SELECT event_id, event_type FROM events WHERE event_id <= (SELECT max(event_id) FROM events WHERE event_type = 'purchase')")
def committed_only(spark, sf_dir):
    return E.committed(_table(spark, sf_dir, "events"), "event_id", F.col("event_type") == "purchase").select("event_id", "event_type")


@query(f"SELECT CAST(sum(length(key) // 2 + octet_length(encode(value))) AS BIGINT) AS size FROM ({_REGION} UNION ALL {_NATION})")
def memtable_size(spark, sf_dir):
    both = _region(spark, sf_dir).union(_nation(spark, sf_dir))
    return E.entry_bytes(E.newest(both.union(both).withColumn("seq", F.lit(0)), ["seq"]))


@query(f"SELECT count(*) AS n, min(key) AS min_key, max(key) AS max_key FROM (SELECT {_ORDER_KEY} AS key FROM orders)")
def file_stats(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select(K.path(K.field(F.lit("orders")), K.field(F.col("o_orderkey").cast("string")), K.lww()).alias("key"))
    return E.stats(rows).select("n", F.hex("min_key").alias("min_key"), F.hex("max_key").alias("max_key"))


@query("SELECT vec_id, i - 1 AS i, embedding[i]::DOUBLE AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def sequence_order(spark, sf_dir):
    """Bulk-loaded list elements read back in the order of their keys."""
    rows = E.sequence_entries(_table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast(T.ArrayType(T.DoubleType()))), K.field(F.col("vec_id").cast("string")), "embedding", 9)
    rows = rows.withColumn("p", K.decode_path_col("key")).select(F.col("p.segments")[0]["field"].cast("long").alias("vec_id"), "key", "value")
    per = rows.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("e"))
    return per.select("vec_id", F.posexplode("e").alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), F.col("x.value").alias("x"))


@query("SELECT '00757365727300616C696365006E616D65001E' AS key, '\"Alice\"' AS value, false AS deleted UNION ALL SELECT '00757365727300616C69636500616765001E', '30', false UNION ALL SELECT '00757365727300626F62001E', NULL, true")
def mutation_entries(spark, sf_dir):
    m = mutation({"users": {"alice": {"name": "Alice", "age": 30}, "bob": DELETE}})
    return spark.createDataFrame([(k.hex().upper(), v, d) for k, v, d in entries(m)], "key string, value string, deleted boolean")


def _folder(spark) -> str:
    """A new folder in the place that all executors share; a temporary one only where the master is local."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp()
    return f"{shared.rstrip('/')}/store-{uuid.uuid4().hex}"


@query("SELECT '006B5F' || hex(printf('%02d', i)) || '001E' AS key, printf('%d', i + CASE WHEN i % 2 = 0 THEN 100 ELSE 0 END) AS value FROM range(20) t(i) WHERE i % 5 <> 0")
def store_commits(spark, sf_dir):
    """Three commits, an abort and a reopening of a store in a folder of its own."""
    base = _folder(spark)
    store = Store(spark, base)
    with store.begin() as tx:
        for i in range(20):
            tx.execute(mutation({f"k_{i:02d}": i}))
        tx.commit()
    with store.begin() as tx:
        tx.insert_all(spark.range(0, 20, 2).select(K.path(K.field(F.concat(F.lit("k_"), F.lpad(F.col("id").cast("string"), 2, "0"))), K.lww()).alias("key"), (F.col("id") + 100).cast("string").alias("value")))
        tx.commit()
    with store.begin() as tx:
        tx.execute(mutation({f"k_{i:02d}": DELETE for i in range(0, 20, 5)}))
        tx.commit()
    with store.begin() as tx:
        tx.execute(mutation({"k_01": "lost"}))
    return Store(spark, base).begin_readonly().resolved(codec.subtree([])).select(F.hex("key").alias("key"), "value")


# ---- the store over whole tables


def _orders_store(spark, sf_dir, versions: int = 2, **options) -> Store:
    """All orders as version 1, those with an even key anew as version 2, those with a key divisible by 5 deleted as version 3."""
    store = Store(spark, Options(_folder(spark), **options))
    orders = _table(spark, sf_dir, "orders")
    key = K.path(K.field(F.lit("orders")), K.field(F.col("o_orderkey").cast("string")), K.lww()).alias("key")
    parts = (
        orders.select(key, F.col("o_orderstatus").alias("value")),
        orders.where("o_orderkey % 2 = 0").select(key, F.lit("new").alias("value")),
        orders.where("o_orderkey % 5 = 0").select(key, F.lit(None).cast("string").alias("value"), F.lit(True).alias("deleted")),
    )
    for part in parts[:versions]:
        with store.begin() as tx:
            tx.insert_all(part)
            tx.commit()
    return store


_NEWEST = f"SELECT {_ORDER_KEY} AS key, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE o_orderstatus END AS value, o_orderkey FROM orders"


@query(f"SELECT key, value FROM ({_NEWEST}) WHERE o_orderkey % 5 <> 0")
def store_resolved(spark, sf_dir):
    """Layers of commits over all orders, with tombstones."""
    return _shown(_orders_store(spark, sf_dir, 3).begin_readonly().resolved(codec.subtree(["orders"])))


@query(f"SELECT {_ORDER_KEY} AS key, o_orderstatus AS value FROM orders")
def store_snapshot_scan(spark, sf_dir):
    """A snapshot of version 1, read after version 2."""
    return _shown(_orders_store(spark, sf_dir).begin_readonly(version=1).scan(codec.subtree(["orders"])))


@query(f"SELECT key, value FROM ({_NEWEST})")
def store_compaction(spark, sf_dir):
    """One version that stands for all before it; what it stands for is deleted."""
    store = _orders_store(spark, sf_dir)
    store.compact()
    store.vacuum()
    return _shown(store.begin_readonly().scan())


@query(f"SELECT {_ORDER_KEY} AS key, o_orderstatus AS value FROM orders")
def store_isolation(spark, sf_dir):
    """A reader that began before the second commit."""
    store = _orders_store(spark, sf_dir, 1)
    reader = store.begin_readonly()
    with store.begin() as tx:
        tx.insert_all(_table(spark, sf_dir, "orders").select(K.path(K.field(F.lit("orders")), K.field(F.col("o_orderkey").cast("string")), K.lww()).alias("key"), F.lit("later").alias("value")))
        tx.commit()
    return _shown(reader.scan())


@query(f"SELECT key, value FROM ({_NEWEST}) WHERE o_orderkey % 10 = 7 OR o_orderkey % 10 = 8")
def store_point_get(spark, sf_dir):
    """Rows of many keys, which prune files by their bounds and bloom filters."""
    keys = _table(spark, sf_dir, "orders").where("o_orderkey % 10 in (7, 8)").select(K.path(K.field(F.lit("orders")), K.field(F.col("o_orderkey").cast("string")), K.lww()).alias("key"))
    return _shown(E.latest(_orders_store(spark, sf_dir).begin_readonly().log().join(keys, "key", "left_semi")))


@query(f"SELECT key, value FROM ({_NEWEST}) WHERE starts_with(CAST(o_orderkey AS VARCHAR), '7')")
def store_prefix_scan(spark, sf_dir):
    """A prefix as a key range, which the Parquet scan gets."""
    return _shown(_orders_store(spark, sf_dir).begin_readonly().scan(codec.encode_segment("orders") + codec.encode_segment("7")))


@query(f"SELECT count(*) AS n, min(key) AS min_key, max(key) AS max_key FROM (SELECT {_ORDER_KEY} AS key FROM orders)")
def store_file_stats(spark, sf_dir):
    """Bounds of what a commit wrote."""
    return E.stats(_orders_store(spark, sf_dir, 1).begin_readonly().log()).select("n", F.hex("min_key").alias("min_key"), F.hex("max_key").alias("max_key"))


@query("SELECT '00' || hex('nation') || '00' || hex(CAST(n_nationkey AS VARCHAR)) || '001E' AS key, '\"' || n_name || '\"' AS value FROM nation")
def store_flush(spark, sf_dir):
    """A buffer of 256 bytes, so a transaction spills many times before it commits."""
    store = Store(spark, Options(_folder(spark), buffer_bytes=256, pid=9))
    with store.begin() as tx:
        for r in _table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():
            tx.execute(mutation({"nation": {str(r["n_nationkey"]): r["n_name"]}}))
        tx.commit()
    return _shown(store.begin_readonly().scan())


@query(f"SELECT 'free' AS first, 'busy' AS second, 'free' AS third, count(*) AS n FROM (SELECT {_ORDER_KEY} AS key FROM orders)")
def store_two_handles(spark, sf_dir):
    """Two handles of one store: the second can't write until the first has ended; what that staged goes; the clock follows."""
    store = _orders_store(spark, sf_dir, 1)
    other = Store(spark, store.base)

    def begin(s):
        try:
            return "free", s.begin()
        except WriterBusy:
            return "busy", None

    first, tx = begin(store)
    tx.insert(b"lost", "1")
    second, _ = begin(other)
    tx.abort()
    third, again = begin(other)
    again.abort()
    late = Store(spark, store.base)
    return late.begin_readonly().log().where(F.col("hlc") < late.clock.next()).agg(F.lit(first).alias("first"), F.lit(second).alias("second"), F.lit(third).alias("third"), F.count("*").alias("n"))


@query(f"SELECT count(*) AS n, 0 AS staged FROM (SELECT {_ORDER_KEY} AS key FROM orders)")
def store_crash_cleanup(spark, sf_dir):
    """A writer that dies with staged rows: its lease runs out and the next opening deletes them."""
    store = _orders_store(spark, sf_dir, 1, lease_seconds=0.0)
    tx = store.begin()
    tx.insert_all(spark.createDataFrame([(bytearray(b"orphan"), "v")], "key binary, value string"))
    late = Store(spark, store.base)
    staged = len(late._fs.listStatus(late._path(f"{late.base}/staging")))
    return late.begin_readonly().log().agg(F.count("*").alias("n"), F.lit(staged).alias("staged"))


# ---- the query language beside its text


@query("SELECT c_custkey AS id, o_orderkey FROM (SELECT * FROM customer WHERE c_custkey > 5 ORDER BY c_custkey LIMIT 40) LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 2) ON o_custkey = c_custkey")
def query_builder(spark, sf_dir):
    """A query built as a tree."""
    q = tree(select("customer", select("c_custkey", alias="id"), select("orders", "o_orderkey", take=2), after="5", take=40))
    return flat(catalog(spark, sf_dir).one(q), "orders")


@query("SELECT * FROM (VALUES ('{ a ! }', 'UnexpectedChar'), ('{ a', 'UnexpectedEnd'), ('{ a(first: 1) }', 'UnknownFilter'), ('{ a(skip: 18446744073709551616) }', 'UnexpectedChar'), ('{ nowhere { x } }', 'BindError'), ('{ orders(take: 1, take: 2) }', 'BindError'), ('{ orders(take: 18446744073709551615) { o_orderkey } }', 'none')) t(text, error)")
def query_errors(spark, sf_dir):
    """What is wrong with a query, and a number at its limit."""

    def error(text: str) -> str:
        try:
            q = Query.parse(text)
            if "18446744073709551615" not in text:
                catalog(spark, sf_dir).run(q)
        except (QueryError, BindError) as e:
            return type(e).__name__
        return "none"

    texts = ("{ a ! }", "{ a", "{ a(first: 1) }", "{ a(skip: 18446744073709551616) }", "{ nowhere { x } }", "{ orders(take: 1, take: 2) }", "{ orders(take: 18446744073709551615) { o_orderkey } }")
    return spark.createDataFrame([(t, error(t)) for t in texts], "text string, error string")


# ---- keys, peers and clocks


@query("SELECT event_id, event_id % 4 < 2 AS valid FROM events")
def index_valid(spark, sf_dir):
    """Whole indices, and those with a byte too few or too many."""
    whole = F.concat(K.varint_col(F.col("user_id") + 1), K.varint_col(F.col("event_id")))
    made = F.when(F.col("event_id") % 4 < 2, whole).when(F.col("event_id") % 4 == 2, whole.substr(F.lit(1), F.length(whole) - 1)).otherwise(F.concat(whole, F.unhex(F.lit("05"))))
    return _table(spark, sf_dir, "events").select("event_id", K.is_index_col(made).alias("valid"))


@query("SELECT event_id, '00' || hex(event_type) || '00' || hex(printf('%06d', user_id)) AS segments, row_number() OVER (ORDER BY event_type, user_id, event_id) AS place FROM events")
def segment_order(spark, sf_dir):
    """Byte order of the encoded segments is the order of the names."""
    from pyspark.sql import Window

    events = _table(spark, sf_dir, "events")
    key = F.concat(K.field(F.col("event_type")), K.field(F.lpad(F.col("user_id").cast("string"), 6, "0")))
    by_type = events.groupBy("event_type").count()
    # places within a type, and the rows of the types before it
    before = by_type.alias("a").join(F.broadcast(by_type.alias("b")), F.col("b.event_type") < F.col("a.event_type"), "left").groupBy(F.col("a.event_type").alias("event_type")).agg(F.coalesce(F.sum("b.count"), F.lit(0)).alias("before"))
    rows = events.select("event_id", "event_type", key.alias("k")).join(F.broadcast(before), "event_type")
    return rows.select("event_id", F.hex("k").alias("segments"), (F.col("before") + F.row_number().over(Window.partitionBy("event_type").orderBy("k", "event_id"))).cast("long").alias("place"))


@query("SELECT DISTINCT user_id + 1 AS pid, printf('%x', user_id + 1) AS shown, user_id + 1 AS back FROM events UNION ALL SELECT 4294967295, 'ffffffff', 4294967295 UNION ALL SELECT 0, '0', NULL")
def pid_text(spark, sf_dir):
    """Peer ids as text and back; 0 is none."""
    pids = _table(spark, sf_dir, "events").select((F.col("user_id") + 1).alias("pid")).distinct().union(spark.createDataFrame([(codec.MAX_U32,), (0,)], "pid long"))
    shown = pids.select("pid", clock.show_pid_col(F.col("pid")).alias("shown"))
    return shown.select("pid", "shown", clock.read_pid_col(F.col("shown")).alias("back"))


@query("SELECT 2000 AS n, 2000 AS distinct_n, true AS increasing, true AS after_remote, true AS in_window, true AS pids_in_range")
def clock_order(spark, sf_dir):
    """Timestamps of a clock that stands still, then sees a remote one far ahead."""
    own = clock.Clock(now=lambda: 1_000_000)
    seen = [own.next() for _ in range(1000)]
    own.sync(1_000_000 + 100_000)
    seen += [own.next() for _ in range(1000)]
    pids = [clock.new_pid() for _ in range(50)]
    row = (len(seen), len(set(seen)), seen == sorted(seen), seen[1000] > 1_100_000, seen[0] & ~clock.LOW == 1_000_000 & ~clock.LOW, all(1 <= p <= codec.MAX_U32 for p in pids))
    return spark.createDataFrame([row], "n int, distinct_n int, increasing boolean, after_remote boolean, in_window boolean, pids_in_range boolean")


@query("SELECT * FROM (VALUES ('6162', 'delimiter'), ('', 'delimiter'), ('0061', 'delimiter'), ('001F0801', 'varint'), ('0061FF001E', 'field'), ('000105', 'index'), ('0061001E', 'none')) t(key, error)")
def path_errors(spark, sf_dir):
    """Why a key can't be read."""

    def error(key: str) -> str:
        try:
            codec.decode_path(bytes.fromhex(key))
        except codec.PathError as e:
            return e.reason
        return "none"

    return spark.createDataFrame([(k, error(k)) for k in ("6162", "", "0061", "001F0801", "0061FF001E", "000105", "0061001E")], "key string, error string")


@query("SELECT * FROM (VALUES ('n', '7'), ('x', '-2.25'), ('t', '\"é\"'), ('b', 'false'), ('z', 'null'), ('m', '{\"k\": [1, null]}'), ('l', '[3, 2]')) t(name, value)")
def mutation_values(spark, sf_dir):
    """Values of every kind, as entries hold them; fields and an index as segments."""
    m = mutation({"n": 7, "x": -2.25, "t": "é", "b": False, "z": None, "m": Assign("m", {"k": [1, None]}), "l": [3, 2]})
    rows = [(codec.decode_path(k)[0][0], v) for k, v, _ in entries(m)]
    return spark.createDataFrame(rows, "name string, value string")


@query("SELECT c_custkey, c_custkey % 3 = 0 AS control, c_custkey % 3 = 1 AS peer FROM customer")
def encoder_checks(spark, sf_dir):
    """Names with a control byte and peer ids over 32 bits, which the encoders refuse."""
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit("\x00x"))).otherwise(F.col("c_name")).alias("name"), F.when(F.col("c_custkey") % 3 == 1, F.col("c_custkey") + (1 << 32)).otherwise(F.col("c_custkey")).alias("pid"))
    try:
        rows.select(K.field(F.col("name")), K.counter(F.col("pid"))).write.format("noop").mode("overwrite").save()
    except Exception as e:
        if "control byte" not in str(e) and "peer id" not in str(e):
            raise
        return rows.select("c_custkey", (~K.valid_field(F.col("name"))).alias("control"), (F.col("pid") > codec.MAX_U32).alias("peer"))
    raise AssertionError("the encoders took bad input")
