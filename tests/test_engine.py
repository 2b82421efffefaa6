import threading

import pytest
from pyspark.sql import functions as F

from arborlog.functions import codec
from arborlog.functions import columns as K
from arborlog.functions.clock import Clock, check_pid, new_pid, show_pid
from arborlog.operators import entries as E
from arborlog.operators.mutation import DELETE, Assign, Compose, Delete, Nested, entries, mutation
from arborlog.plans.binder import BindError, Catalog, Collection
from arborlog.sources.store import Options, Store, WriterBusy


def key(*segments):
    return codec.encode_path(list(segments))


# ---- clock


def test_clock_is_unique_over_threads():
    clock, out = Clock(), []

    def draw():
        mine = [clock.next() for _ in range(1000)]
        assert mine == sorted(mine)
        out.extend(mine)

    threads = [threading.Thread(target=draw) for _ in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(set(out)) == 8000


def test_clock_window_and_sync():
    clock = Clock(lambda: 1_000_000)
    first = clock.next()
    assert abs(first - 1_000_000) < 256
    assert clock.sync(first + 100_000) == first
    assert clock.next() == first + 100_001
    assert clock.sync(5) == first + 100_001 and clock.next() == first + 100_002


def test_pids():
    assert 1 <= new_pid() <= codec.MAX_U32 and show_pid(255) == "ff"
    for bad in (0, 1 << 32):
        with pytest.raises(ValueError):
            check_pid(bad)


# ---- mutations


def test_mutation_literals():
    m = mutation({"a": 42, "b": 2.5, "c": "Alice", "d": True, "e": None, "f": [1, 2, 3], "g": DELETE, "u": {"alice": {"age": 3}}, b"\x01\x01\x01\x02": "x", "m": Assign("m", {"key": "value"})})
    assert m == Compose((Assign("a", 42), Assign("b", 2.5), Assign("c", "Alice"), Assign("d", True), Assign("e", None), Assign("f", [1, 2, 3]), Delete("g"), Nested("u", (Nested("alice", (Assign("age", 3),)),)), Assign(b"\x01\x01\x01\x02", "x"), Assign("m", {"key": "value"})))
    found = list(entries(m))
    assert found[0] == (key("a"), "42", False) and found[4] == (key("e"), "null", False) and found[6] == (key("g"), None, True)
    assert found[7][0] == key("u", "alice", "age") and found[8][0] == key(b"\x01\x01\x01\x02") and found[9][1] == '{"key": "value"}'


def test_mutation_checks_each_path_alone():
    assert len(list(entries(mutation({"n": {f"{i:04d}" + "x" * 2000: i for i in range(40)}})))) == 40
    with pytest.raises(codec.PathError):
        list(entries(mutation({"bad\n": 1})))


# ---- resolution


def test_registers_do_not_depend_on_order(spark):
    rows = [(b"k", v, False, t, p, 1, s) for s, (t, p, v) in enumerate([(10, 1, "old"), (20, 1, "new"), (20, 2, "hi-pid"), (20, 2, "tie")])]
    for r in (rows, rows[::-1]):
        assert E.resolve(spark.createDataFrame(r, E.LOG)).first()["value"] == "tie"


def test_storage_rule_and_three_kinds_of_nothing(spark):
    rows = [(b"a", "1", False, 99, 1, 1, 0), (b"a", "2", False, 1, 1, 2, 0), (b"b", None, False, 1, 1, 1, 0), (b"c", None, True, 1, 1, 1, 1)]
    log = spark.createDataFrame(rows, E.LOG)
    assert {bytes(r["key"]): r["value"] for r in E.latest(log).collect()} == {b"a": "2", b"b": None, b"c": None}
    assert {bytes(r["key"]): r["value"] for r in E.live(E.resolve(log)).collect()} == {b"a": "1", b"b": None}


def test_entry_bytes_counts_an_overwritten_key_once(spark):
    log = spark.createDataFrame([(b"key", "val", 1), (b"key", "longer", 2)], "key binary, value string, seq long")
    assert E.entry_bytes(E.newest(log, ["seq"])).first()["size"] == 9


def test_prefix_range_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(bytearray(k), "v") for k in (b"abc/1", b"abc/2", b"abd/1", b"xyz", b"\xff\xff")], "key binary, value string").write.parquet(str(tmp_path / "t"))
    df = E.with_prefix(spark.read.parquet(str(tmp_path / "t")), b"abc/")
    assert df.count() == 2
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan
    assert E.with_prefix(spark.read.parquet(str(tmp_path / "t")), b"\xff").count() == 1
    assert E.with_prefix(spark.read.parquet(str(tmp_path / "t")), b"").count() == 5


def test_native_encoders_equal_the_codec(spark):
    df = spark.createDataFrame([(0,), (1,), (255,), (256,), ((1 << 63) - 1,), (None,)], "n long")
    for r in df.select("n", K.varint_col(F.col("n")).alias("b"), K.read_varint_col(K.varint_col(F.col("n"))).alias("back")).collect():
        assert r["n"] is None or (bytes(r["b"]) == codec.varint(r["n"]) and r["back"] == r["n"])
    with pytest.raises(Exception, match="negative"):
        spark.range(1).select(K.varint_col(F.lit(-1))).collect()
    with pytest.raises(Exception, match="too long"):
        spark.range(1).select(K.path(K.field(F.repeat(F.lit("a"), 32767)), K.lww(), checked=True)).collect()


def test_broken_keys_decode_to_null(spark):
    df = spark.createDataFrame([(bytearray(key("a", "b")),), (bytearray(b"junk"),), (None,)], "key binary")
    rows = [r["p"] for r in df.select(K.decode_path_col("key").alias("p")).collect()]
    assert [s["field"] for s in rows[0]["segments"]] == ["a", "b"] and rows[1]["segments"] is None and rows[2]["term"] is None


# ---- queries


@pytest.fixture(scope="module")
def catalog(spark):
    users = spark.createDataFrame([(1, "a", {"x": 1, "y": 2}, [5, 6, 7]), (2, "b", {}, []), (3, None, None, None)], "id long, name string, m map<string,long>, xs array<long>")
    friends = spark.createDataFrame([(1, i, f"f{i}") for i in range(5)] + [(2, 9, "f9")], "user long, n long, name string")
    return Catalog(users=Collection(users, ["id"], {"friends": ("friends", ["id"], ["user"])}), friends=Collection(friends, ["user", "n"]))


def test_page_per_parent(catalog):
    rows = catalog.one("{ users { id, friends(skip: 1, take: 2) { name as who } } }").orderBy("id").collect()
    assert [[f["who"] for f in r["friends"]] for r in rows] == [["f1", "f2"], [], []]


def test_cursors(catalog):
    names = lambda q: [r[0] for r in catalog.one(q).collect()]
    assert names('{ users(after: "1") { id } }') == [2, 3]
    assert names('{ users(before: "3", take: 1) { id } }') == [2]
    assert names('{ users(take: 1, after: "0") { id } }') == [1]
    assert names('{ users(after: "1", before: "3") { id } }') == [2]
    assert names("{ users(take: 0) { id } }") == []
    assert names('{ friends(after: "1/3") { name } }') == ["f4", "f9"]


def test_maps_and_arrays(catalog):
    r = catalog.one('{ users(take: 1) { m(after: "x"), xs(skip: 1, take: 5) } }').first()
    assert [(e["key"], e["value"]) for e in r["m"]] == [("y", 2)] and r["xs"] == [6, 7]


@pytest.mark.parametrize("text", ["{ nobody }", "{ users { nothing } }", "{ users { id, name as id } }", "{ users(skip: 1, skip: 2) { id } }", "{ users { id(take: 1) } }", '{ friends(after: "1") { n } }', "{ users { name { x } } }"])
def test_bind_errors(catalog, text):
    with pytest.raises(BindError):
        catalog.run(text)


# ---- store


@pytest.fixture
def base(tmp_path):
    return f"file://{tmp_path}/db"


def put(store, rows):
    with store.begin() as tx:
        for k, v in rows.items():
            tx.insert(k, v)
        return tx.commit()


def test_commit_get_scan(spark, base):
    store = Store(spark, base)
    assert store.begin_readonly().get(b"hello") is None
    put(store, {b"shelf/17": "1", b"shelf/9": "2", b"desk/4": "3"})
    snapshot = store.begin_readonly()
    assert snapshot.get(b"shelf/9") == ("2", False)
    assert [bytes(r["key"]) for r in snapshot.scan(b"shelf/").collect()] == [b"shelf/17", b"shelf/9"]


def test_isolation_abort_and_read_your_writes(spark, base):
    store = Store(spark, base)
    put(store, {b"k": "v1"})
    before = store.begin_readonly()
    tx = store.begin()
    tx.insert(b"k", "v2")
    assert tx.get(b"k") == ("v2", False) and store.begin_readonly().get(b"k") == ("v1", False)
    with pytest.raises(WriterBusy):
        store.begin()
    tx.abort()
    assert store.begin_readonly().get(b"k") == ("v1", False)
    put(store, {b"k": "v3"})
    assert before.get(b"k") == ("v1", False) and store.begin_readonly().get(b"k") == ("v3", False)
    assert store.begin_readonly(version=1).get(b"k") == ("v1", False)


def test_spill_overwrite_and_reopen_twice(spark, base):
    store = Store(spark, Options(base, buffer_bytes=256, pid=7))
    put(store, {f"key_{i:04d}".encode(): f"value_{i:04d}" for i in range(50)} | {b"item": "v1"})
    put(store, {b"item": "v2"})
    for _ in range(2):
        again = Store(spark, base)
        assert again.begin_readonly().scan(b"key_").count() == 50 and again.begin_readonly().get(b"item") == ("v2", False)


def test_last_assignment_of_a_transaction_wins_and_tombstones_show(spark, base):
    store = Store(spark, base)
    with store.begin() as tx:
        tx.execute(mutation({"a": 1}))
        tx.execute(mutation({"a": 2, "b": {"c": 3}, "d": DELETE}))
        assert tx.get(key("a")) == ("2", False)
        tx.commit()
    snapshot = store.begin_readonly()
    assert snapshot.get(key("a")) == ("2", False) and snapshot.get(key("d")) == (None, True)
    assert snapshot.resolved().count() == 2
    with store.begin() as tx:
        tx.execute(mutation({"b": DELETE}))
        tx.commit()
    assert store.begin_readonly().get(key("b", "c")) == ("3", False)


def test_a_live_writer_keeps_its_rows_when_others_open_the_store(spark, base):
    store = Store(spark, base)
    tx = store.begin()
    tx.insert_all(spark.createDataFrame([(bytearray(b"k"), "v")], "key binary, value string"))
    other = Store(spark, base)
    with pytest.raises(WriterBusy):
        other.begin()
    with pytest.raises(WriterBusy):
        other.compact()
    assert tx.commit() == 1 and other.begin_readonly().get(b"k") == ("v", False)
    put(other, {b"k": "w"})
    assert other.compact() == 3 and other.vacuum() == 2
    assert Store(spark, base).begin_readonly().get(b"k") == ("w", False) and len(other._fs.listStatus(other._path(f"{other.base}/data"))) == 1


def test_encoders_refuse_bad_input_and_paging_has_no_single_task(spark):
    bad = spark.createDataFrame([("a\x00b", 1 << 32, "x" * 40_000)], "name string, pid long, long string")
    for column in (K.field(F.col("name")), K.counter(F.col("pid")), K.index((F.lit(0), F.lit(1))), K.path(K.field(F.col("long")), K.lww())):
        with pytest.raises(Exception, match="control byte|peer id|too long"):
            bad.select(column).collect()
    rows = spark.createDataFrame([(i, i % 7) for i in range(100)], "id long, g long")
    cat = Catalog(a=Collection(rows, ["id"], {"b": ("b", ["id"], ["parent"])}), b=Collection(spark.createDataFrame([(i, i % 50 if i % 3 else None) for i in range(300)], "key long, parent long"), ["key"]))
    assert [r["id"] for r in cat.one("{ a(skip: 90) { id } }").collect()] == list(range(90, 100))
    assert [r["id"] for r in cat.one('{ a(skip: 95, before: "99") { id } }').collect()] == [3, 2, 1, 0]
    assert cat.one("{ a(skip: 100) { id } }").count() == 0
    plan = cat.one("{ a(skip: 90) { id } }")._jdf.queryExecution().executedPlan().toString()
    assert "CollectLimit" not in plan and "SinglePartition" not in plan.split("TakeOrdered")[0]
    paged = cat.one("{ a(skip: 3, take: 4) { id, b(take: 2) { key } } }")
    assert "LeftSemi" in paged._jdf.queryExecution().executedPlan().toString()
    for r in paged.collect():
        assert [x["key"] for x in r["b"]] == [k for k in range(300) if k % 3 and k % 50 == r["id"]][:2]


def test_orphans_bad_keys_and_compaction(spark, base):
    store = Store(spark, Options(base, lease_seconds=0.0))
    for i in range(3):
        put(store, {f"key_{i}".encode(): f"val_{i}", b"same": str(i)})
    tx = store.begin()
    for bad in (b"", b"x" * 32768):
        with pytest.raises(codec.PathError):
            tx.insert(bad, "v")
    tx.insert_all(spark.createDataFrame([(bytearray(b"orphan"), "v")], "key binary, value string"))
    again = Store(spark, base)
    assert again.begin_readonly().get(b"orphan") is None
    assert again.compact() == 4 and len(again.begin_readonly().manifests) == 1
    assert again.begin_readonly().get(b"same") == ("2", False) and again.begin_readonly().scan().count() == 4
    with again.begin() as tx:
        tx.insert(b"same", "9")
        assert tx.commit() == 5
    assert again.begin_readonly().get(b"same") == ("9", False)


def test_streaming_registers(spark, tmp_path):
    from arborlog.streaming.registers import start_registers, stream_log

    rows = [(bytearray(b"k"), v, False, t, 1, 1, t) for t, v in ((10, "old"), (30, "new"), (20, "mid"))]
    spark.createDataFrame(rows, E.LOG).repartition(3).write.parquet(str(tmp_path / "log"))
    q = start_registers(stream_log(spark, str(tmp_path / "log")), "registers", str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [r["value"] for r in spark.table("registers").collect()] == ["new"]
