"""Operator 6: mixing sources to target weights by a min-cost flow from membership patterns to source quotas."""

from __future__ import annotations

import heapq
from json import loads

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import small, word_count_column, written

#: Cost of a word's first, second, third copy; it must not fall, so a copy is never taken before the one before it.
COPY_COSTS = (0, 1, 3)
#: Membership patterns at most that have a node of their own in the flow network, those of most words first.
#: Documents of any others count for their own source alone.
MOST_PATTERNS = 20_000
BUCKETS = 4096
#: Documents at least, after a pattern's cut, that may fill what is left of its words.
EDGE = 64


def capped_targets(sizes: dict, weights: dict, most: float = 3.0) -> dict:
    """All words shared by weight; a source above ``most`` times its size stops there and its excess is shared again by weight."""
    targets, free, left = {}, list(sizes), float(sum(sizes.values()))
    while free:
        total = sum(weights[s] for s in free)
        above = [s for s in free if left * weights[s] / total > most * sizes[s]]
        if not above:
            return targets | {s: left * weights[s] / total for s in free}
        for s in above:
            targets[s] = most * sizes[s]
            left -= targets[s]
        free = [s for s in free if s not in set(above)]
    return targets


def cycled_weights(sources, cycle=(5, 2, 1)) -> dict:
    """Weights of the cycle over the sources by code point, null last."""
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: cycle[i % len(cycle)] for i, s in enumerate(order)}


class FlowNetwork:
    """Min-cost maximum flow by shortest augmenting paths with potentials; all costs are 0 or more."""

    def __init__(self, n: int):
        self.n, self.to, self.cap, self.cost, self.out = n, [], [], [], [[] for _ in range(n)]

    def arc(self, a: int, b: int, cap: int, cost: int) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> int:
        potential, flow = [0] * self.n, 0
        while True:
            dist = [None] * self.n
            dist[s], heap = 0, [(0, s)]
            while heap:
                d, x = heapq.heappop(heap)
                if d > dist[x]:
                    continue
                for e in self.out[x]:
                    if self.cap[e] > 0:
                        y, nd = self.to[e], d + self.cost[e] + potential[x] - potential[self.to[e]]
                        if dist[y] is None or nd < dist[y]:
                            dist[y] = nd
                            heapq.heappush(heap, (nd, y))
            if dist[t] is None:
                return flow
            potential = [p + (d if d is not None else dist[t]) for p, d in zip(potential, dist)]
            # all cheapest paths at once: a maximum flow over the arcs of reduced cost 0
            while pushed := self._blocking(s, t, potential):
                flow += pushed

    def _blocking(self, s: int, t: int, potential: list[int]) -> int:
        """A blocking flow over the shortest paths of arcs of reduced cost 0."""
        free = lambda e, x: self.cap[e] > 0 and self.cost[e] + potential[x] == potential[self.to[e]]
        level, queue = [-1] * self.n, [s]
        level[s] = 0
        for x in queue:
            for e in self.out[x]:
                if level[self.to[e]] < 0 and free(e, x):
                    level[self.to[e]] = level[x] + 1
                    queue.append(self.to[e])
        if level[t] < 0:
            return 0
        at, total, path, x = [0] * self.n, 0, [], s
        while True:
            if x == t:
                push = min(self.cap[e] for e in path)
                for e in path:
                    self.cap[e] -= push
                    self.cap[e ^ 1] += push
                total += push
                path, x = [], s
            while at[x] < len(self.out[x]):
                e = self.out[x][at[x]]
                if level[self.to[e]] == level[x] + 1 and free(e, x):
                    path.append(e)
                    x = self.to[e]
                    break
                at[x] += 1
            else:
                if not path:
                    return total
                level[x] = -1
                x = self.to[path.pop() ^ 1]


def route(patterns: list[tuple[tuple, int]], targets: dict, costs=COPY_COSTS, limits: list[dict] | None = None) -> list[dict]:
    """Words that each pattern (its sources, its size) sends to each source's quota, at the least cost of repetition.

    limits: for each pattern the words at most that go to each of its sources; copies beyond the costs, where the limits
    allow any, cost twice the last one.
    """
    sources = list(targets)
    place = {s: 1 + len(patterns) + i for i, s in enumerate(sources)}
    net = FlowNetwork(2 + len(patterns) + len(sources))
    end = net.n - 1
    arcs: list[dict] = []
    for i, (members, size) in enumerate(patterns):
        most = {s: limits[i][s] if limits else len(costs) * size for s in members if s in place}
        for cost in costs:
            net.arc(0, 1 + i, size, cost)
        if limits and (more := sum(most.values()) - len(costs) * size) > 0:
            net.arc(0, 1 + i, more, 2 * costs[-1])
        arcs.append({s: net.arc(1 + i, place[s], m, 0) for s, m in most.items()})
    for s in sources:
        net.arc(place[s], end, round(targets[s]), 0)
    net.run(0, end)
    return [{s: net.cap[e ^ 1] for s, e in a.items() if net.cap[e ^ 1]} for a in arcs]


def _bucket_sums(keyed: DataFrame) -> DataFrame:
    """(__pattern, __b, size, n): words and documents of each hash bucket of each group."""
    return written(keyed.groupBy("__pattern", "__b").agg(F.sum("size").alias("size"), F.count("*").alias("n")))


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    return docs.withColumn("__h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("__b", F.pmod("__h", F.lit(BUCKETS)))


def _selected(keyed: DataFrame, sums: DataFrame, plan: list[tuple[str, int, int]]) -> DataFrame:
    """keyed with ``taken``; plan: (group, times that all its documents are taken, words that are left for some of them)."""
    plan = keyed.sparkSession.createDataFrame(plan, "__pattern string, __full int, __rest long")
    before = Window.partitionBy("__pattern").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"__below": F.coalesce(F.sum("size").over(before), F.lit(0)), "__docs": F.coalesce(F.sum("n").over(before), F.lit(0))}).join(F.broadcast(plan), "__pattern")
    cut = sums.where("__below <= __rest").groupBy("__pattern", "__full", "__rest").agg(F.max(F.struct("__b", "__below", "__docs")).alias("c"))
    cut = cut.select("__pattern", "__full", F.col("c.__b").alias("__cut"), F.col("c.__docs").alias("__at"), (F.col("__rest") - F.col("c.__below")).alias("__left"))
    last = sums.select("__pattern", "__b", "__docs").join(F.broadcast(cut.select("__pattern", "__cut", "__at")), "__pattern").where(f"__b >= __cut and __docs - __at < {EDGE}").groupBy("__pattern").agg(F.max("__b").alias("__last"))
    cut = cut.drop("__at").join(F.broadcast(last), "__pattern").withColumnRenamed("__pattern", "__p")
    # one row for each group, of which the plan has a bounded number
    placed = keyed.join(F.broadcast(cut), F.col("__pattern") == F.col("__p"), "left")
    placed = placed.withColumn("__full", F.coalesce("__full", F.lit(0)))
    whole = placed.where("__cut is null or __b < __cut or __b > __last").withColumn("__once", F.when(F.col("__b") < F.col("__cut"), 1).otherwise(0))
    edge = placed.where("__b between __cut and __last").repartition("__pattern").sortWithinPartitions("__pattern", "__h", "doc_id", "size")

    def fill(it):
        now = None
        for batch in it:
            once = []
            for pattern, size, left in zip(*(batch.column(c).to_pylist() for c in ("__pattern", "size", "__left"))):
                if now is None or pattern != now[0]:
                    now = [pattern, left]
                fits = 0 < size <= now[1]
                now[1] -= size * fits
                once.append(int(fits))
            yield batch.append_column("__once", pa.array(once, pa.int32()))

    edge = edge.mapInArrow(fill, T.StructType([*edge.schema.fields, T.StructField("__once", T.IntegerType())]))
    return whole.unionByName(edge).withColumn("taken", (F.col("size") * (F.col("__full") + F.col("__once"))).cast("long")).drop("__pattern", "__h", "__b", "__p", "__full", "__cut", "__last", "__left", "__once")


def _times(group: str, size: int, words: int, most: int) -> tuple[str, int, int]:
    full = min(most, words // size) if size else 0
    return group, int(full), int(words - full * size)


def mix_sources(docs: DataFrame, targets: dict, costs=COPY_COSTS, seed: int = 17) -> DataFrame:
    """docs (doc_id, size, sources: array of the sources a document is in) with ``taken``: the words the mix takes of it.

    Documents are summed up by membership pattern; the flow gives each pattern its words; a pattern's
    documents are all taken as often as that goes in full, and the rest is made of documents in the
    order of a seeded hash of the id; documents after the cut fill what is left where they fit.  No document is taken more often than
    there are costs.  A null or empty list of sources, a size of 0 and a source without a target are taken 0
    times; of more than MOST_PATTERNS patterns those of fewest words count for the first of their sources.
    A pattern of any size is cut in hash buckets, of which those at the cut only are put in order.
    """
    json = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    keyed = _keyed(docs.withColumn("__pattern", F.coalesce(json(F.array_sort(F.array_distinct("sources"))), F.lit("[]"))), seed)
    by = keyed.groupBy("__pattern").agg(F.sum("size").alias("w"), F.count("*").alias("n"))
    if by.count() > MOST_PATTERNS:
        top = by.orderBy(F.desc("w"), "__pattern").limit(MOST_PATTERNS).select(F.col("__pattern").alias("__p"))
        first = json(F.slice(F.array_sort(F.array_distinct("sources")), 1, 1))
        keyed = keyed.join(F.broadcast(top), F.col("__pattern") == F.col("__p"), "left").withColumn("__pattern", F.when(F.col("__p").isNull(), first).otherwise(F.col("__pattern"))).drop("__p")
    sums = _bucket_sums(keyed)
    rows = sorted((r["__pattern"], int(r["size"] or 0)) for r in sums.groupBy("__pattern").agg(F.sum("size").alias("size")).collect())
    flows = route([(tuple(loads(p)), size) for p, size in rows], targets, costs)
    return _selected(keyed, sums, [_times(p, size, sum(f.values()), len(costs)) for (p, size), f in zip(rows, flows)])


def mix_by_cycle(docs: DataFrame, cycle=(5, 2, 1), seed: int = 17) -> DataFrame:
    """Per document: doc_id, size (words), source_size, target and taken, for sources weighted in a cycle.

    Sources overlap where a text stands in several: its membership pattern is the set of the sources that
    have it.  The flow sends a pattern's words to its sources' quotas; the first copy of a text is free wherever
    it goes, later ones cost more, so a source takes texts of its own before it repeats what another has
    taken.  What goes to a source is taken of that source's rows, at most three times their size.

    A null text has size 0; a null source is a source of its own, last in order; null ids and repeated rows come
    back as often; other columns are ignored; an empty table gives no rows.  Of more than MOST_PATTERNS
    patterns those of fewest words count for their rows' own source.
    """
    most = len(COPY_COSTS)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = written(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count_column().alias("size"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")))
    sizes = {r["source"]: int(r["size"]) for r in sized.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    targets = capped_targets(sizes, cycled_weights(sizes, cycle), float(most))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    spark = docs.sparkSession
    # one row for each source
    facts = spark.createDataFrame([(s, i, sizes[s], float(targets[s])) for i, s in enumerate(order)], "s string, sid int, source_size long, target double")
    rows = sized.join(F.broadcast(facts), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    texts = rows.groupBy("t1", "t2").agg(F.max("size").alias("size"), F.array_sort(F.collect_set("sid")).alias("p")).withColumn("p", F.to_json("p"))
    several = written(texts.where("instr(p, ',') > 0"))
    by = several.groupBy("p").agg(F.sum("size").alias("words"))
    top = by.orderBy(F.desc("words"), "p").limit(MOST_PATTERNS).toArrow().to_pylist()
    kept = spark.createDataFrame([(r["p"],) for r in top], "p string")
    several = several.join(F.broadcast(kept), "p").select("t1", "t2", "p")
    own = F.concat(F.lit("["), F.col("sid"), F.lit("]"))
    keyed = rows.join(small(several, several.count()), ["t1", "t2"], "left").withColumn("p", F.coalesce("p", own))
    keyed = _keyed(keyed.withColumn("__pattern", F.concat("p", F.lit("/"), F.col("sid"))), seed)
    sums = _bucket_sums(keyed)
    words = {r["__pattern"]: int(r["size"]) for r in sums.groupBy("__pattern").agg(F.sum("size").alias("size")).collect()}
    # of texts in one source only, copies within it are rows of their own
    distinct = {r["p"]: int(r["words"]) for r in top}
    patterns = sorted({g.rpartition("/")[0] for g in words})
    members = [tuple(loads(p)) for p in patterns]
    size = [distinct.get(p, words.get(f"{p}/{m[0]}", 0)) for p, m in zip(patterns, members)]
    limits = [{i: most * words.get(f"{p}/{i}", 0) for i in m} for p, m in zip(patterns, members)]
    flows = route(list(zip(members, size)), {i: targets[s] for i, s in enumerate(order)}, COPY_COSTS, limits)
    plan = [_times(g, words[g], flow.get(i, 0), most) for p, flow, m in zip(patterns, flows, members) for i in m if (g := f"{p}/{i}") in words]
    mixed = _selected(keyed, sums, plan)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_by_cycle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
