"""The operators on small planted tables: results by brute force, and nulls, empties, repeats, long texts, clashing columns."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlog.llm import chat_format, decontaminate, language_id, license_scan, ngram_join, private_data, quality_model, quality_rules, source_mix, url_reputation
from arborlog.llm.components import connected_components, merged_components

WORDS = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("", "n", "r", "st", "le")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, token string, size int, host string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, k):
    words = text.split(" ")
    for i in rng.sample(range(len(words)), k):
        words[i] = rng.choice(WORDS)
    return " ".join(words)


def table(spark, texts, lang=None, source=None):
    """documents with columns whose names clash with internal ones."""
    rows = [(i, t, lang[i] if lang else "en", source[i % len(source)] if source else f"s{i % 3}", len(t or ""), 1, "x", 2, "h") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = [prose(rng, rng.choice((30, 80, 200))) for _ in range(60)]
    family = [edited(rng, base[0], k) for k in (1, 1, 2, 3, 1, 2, 5) for _ in range(6)]
    passage = prose(rng, 60)
    shared = [passage + " " + prose(rng, k) for k in (6, 8, 10, 12, 14, 60, 80) for _ in range(4)]
    odd = [None, "", " \t\n", "one", "One", "two words", "two  words", "é\u2003x y z w v", prose(rng, 30_000), "a" * 70_000, base[5], base[5], base[5].upper()]
    return base + family + shared + odd


# ---- 1


def sets_of(texts):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def components_of(sets):
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return [find(i) for i in range(len(sets))]


def test_ngram_join_equals_brute_force(spark, texts):
    sets = sets_of(texts)
    want = {(i, len(s), c) for i, (s, c) in enumerate(zip(sets, components_of(sets)))}
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(table(spark, texts)).collect()}
    assert got == want


def test_ngram_join_repeats_null_ids_and_empty(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f")]
    got = sorted(((r["doc_id"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert [g for g in got if g[0] is not None] == [(1, 1), (1, 1), (2, 1)] and len(got) == 4
    assert ngram_join.ngram_jaccard_join(spark.createDataFrame([], SCHEMA)).count() == 0


def test_links_and_their_number_equal_brute_force(spark, texts):
    sets = sets_of(texts)
    near = {(i, j): len(sets[i] & sets[j]) for i, j in itertools.combinations(range(len(sets)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(frozenset(s) if s else i, i)
    rep = [first[frozenset(s) if s else i] for i, s in enumerate(sets)]
    links, members = ngram_join.ngram_links(table(spark, texts))
    assert {(r["a"], r["b"]): r["shared"] for r in links.collect()} == {(i, j): m for (i, j), m in near.items() if rep[i] == i and rep[j] == j and rep[i] != rep[j]}
    count = Counter(x for pair in near for x in pair)
    assert {tuple(r) for r in members.collect()} == {(i, len(s), rep[i], count[i]) for i, s in enumerate(sets)}
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f"), (3, None)]
    links, members = ngram_join.ngram_links(spark.createDataFrame(rows, "doc_id long, text string"))
    assert links.count() == 0
    assert {(r["doc_id"], r["n_links"]) for r in members.collect()} == {(1, 1), (2, 1), (3, 0), (None, 0)}
    assert all(x.count() == 0 for x in ngram_join.ngram_links(spark.createDataFrame([], SCHEMA)))


def test_bitmap_bounds_the_intersection():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x = rng.integers(0, 1 << 63, rng.integers(1, 400), dtype=np.uint64)
        y = np.concatenate((x[: rng.integers(0, len(x) + 1)], rng.integers(0, 1 << 63, rng.integers(0, 400), dtype=np.uint64)))
        assert ngram_join.most_shared(ngram_join.bitmap(x), len(x), ngram_join.bitmap(y), len(y)) >= len(np.intersect1d(x, y))


def test_large_families_are_met_in_parts(spark, monkeypatch):
    rng = random.Random(31)
    base = prose(rng, 120)
    texts = [edited(rng, base, rng.choice((1, 2, 3, 4))) for _ in range(160)] + [edited(rng, base, 14) for _ in range(20)]
    sets = sets_of(texts)
    want = {(i, c) for i, c in enumerate(components_of(sets))}
    read = lambda: {(r["doc_id"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(table(spark, texts)).collect()}
    assert read() == want
    rows = [(t, 100, p, d, d) for t in range(3) for d in range(50) for p in (d % 7,)]
    df = spark.createDataFrame(rows, "token long, n int, pos int, doc_id long, comp long")
    whole, parts = ([tuple(r) for r in ngram_join.crossings(df, 80, part=k).collect()] for k in (4096, 8))
    assert sorted(whole) == sorted(parts) and len(whole) == 3 * 50 * 49 // 2


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 130)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for link in links for x in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    assert got == {x: find(x) for link in links if None not in link and link[0] != link[1] for x in link}
    assert got == {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long"), in_task=0).collect()}
    df, found = (lambda part: spark.createDataFrame(part, "a long, b long")), connected_components(spark.createDataFrame(links[::3], "a long, b long"))
    for part in (links[1::3], links[2::3], links[:5], [(None, 3)]):
        found = merged_components(found, df(part))
    rows = [tuple(r) for r in found.collect()]
    assert dict(rows) == got and len(rows) == len(got)


# ---- 2


def test_decontaminate(spark):
    rng = random.Random(5)
    items = [prose(rng, n) for n in (15, 20, 37, 59, 24)] + ["too short", None, ""]
    near = [edited(rng, items[k % 5], 1 + k % 2) for k in range(20)]
    docs = [prose(rng, 200) for _ in range(80)] + [None, "", "word"]
    planted = {}
    for k in range(20):
        at = len(docs)
        middle = items[k % 5] if k < 5 else near[k]
        docs.append(prose(rng, 40) + (" " if k % 2 else "\n") + (middle.upper() if k % 3 == 0 else middle.replace(" ", ", ")) + ". " + prose(rng, 3000 if k == 7 else 50))
        planted[at] = k % 5
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r["doc_id"]: r["item_id"] for r in decontaminate.leaks(table(spark, docs), bench).collect()}
    assert got == planted
    assert decontaminate.decontaminate(table(spark, docs), bench).count() == len(docs) - 20
    assert decontaminate.leaks(table(spark, docs), spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert decontaminate.leaks(spark.createDataFrame([], SCHEMA), bench).count() == 0


def at_the_budget(rng, text, kinds):
    words = text.split(" ")
    for _ in range(int(0.15 * len(words))):
        kind, i = rng.choice(kinds), rng.randrange(len(words))
        words[i : i + (kind != "i")] = [] if kind == "d" else [f"new{rng.randrange(10**6)}"]
    return " ".join(words)


def recall_of(kinds, n, trials=60):
    """Share of items of n words that are found in random prose after edits at the full budget."""
    import pyarrow as pa

    rng = random.Random(f"{kinds}{n}")
    items = [prose(rng, n) for _ in range(trials)]
    words = [decontaminate.plain_words(*decontaminate.text_buffer(pa.array([t])))[0] for t in items]
    index = decontaminate.Index(list(range(trials)), words, 0.15)
    texts = [prose(rng, rng.randint(0, 40)) + " " + at_the_budget(rng, t, kinds) + " " + prose(rng, rng.randint(0, 40)) for t in items]
    found = {(r, i) for r, i, *_ in decontaminate._matches(pa.array(texts), [index])}
    return sum((i, i) in found for i in range(trials)) / trials


@pytest.mark.parametrize("n", [5, 8, 20, 40, 60, 100, 200])
@pytest.mark.parametrize("kinds", ["d", "i", "s", "dis"])
def test_recall_at_the_full_edit_budget(kinds, n):
    assert recall_of(kinds, n) >= 0.95


def test_items_by_id_short_items_null_ids_and_repeated_parts(spark):
    rng = random.Random(33)
    long = prose(rng, 30)
    bench = spark.createDataFrame([(1, long), (1, "two words"), (1, long), (2, "uniqueword"), (3, None), (None, long)], "item_id long, text string")
    docs = [(None, f"x {long} y"), (7, "has Two, words here"), (7, "has two words here"), (8, f"UNIQUEWORD! {long} " * 400), (9, "two more words")]
    got = sorted((r["doc_id"] or -1, r["item_id"], r["distance"], r["start"]) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect())
    assert got == [(-1, 1, 0, 2), (7, 1, 0, 4), (7, 1, 0, 4), (8, 1, 0, 12), (8, 2, 0, 0)]
    left = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    assert sorted(r["doc_id"] for r in left.collect()) == [7, 7, 9]


def test_best_match_is_the_edit_distance():
    rng = random.Random(8)

    def brute(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, d[0] = d[0], i + 1
            for j, y in enumerate(b):
                last, d[j + 1] = d[j + 1], min(d[j + 1] + 1, d[j] + 1, last + (x != y))
        return d[-1]

    for _ in range(60):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(1, 7))] for _ in range(2))
        dist, i, j = decontaminate.best_match(np.array(a), np.array(b))
        assert dist == brute(a, b[i:j]) == min(brute(a, b[x:y]) for x in range(len(b) + 1) for y in range(x, len(b) + 1))


# ---- 3


def test_url_parts_rules_and_reputation(spark):
    urls = [None, "", "nothing", "http://A.Example.ORG/es/x?y", "https://example.org/en/1?z", "http://notexample.org/en/1", "http://b.com", "http://b.com/fr/1#a", "ftp://x.y.com:80/de/2", "a://b://c/d", "http://bad.net/1/2", "http://good.net/1/2"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    outcomes = spark.createDataFrame([("bad.net", 1)] * 60 + [("good.net", 0)] * 60 + [(f"h{i}.net", i % 2) for i in range(20) for _ in range(20)] + [(None, 1), ("x", None)], "host string, bad int")
    got = {r["page_id"]: tuple(r)[1:] for r in url_reputation.url_filter(pages, outcomes).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[4] == ("example.org", "/en/1", "example.org/en/1", "block")
    assert got[5] == ("notexample.org", "/en/1", "org/", "allow")
    assert got[6] == ("b.com", "", None, "allow") and got[7][2:] == ("com/fr/", "allow") and got[8] == ("x.y.com:80", "/de/2", None, "allow")
    assert got[9][:2] == ("b:", "//c/d") and got[10][3] == "block" and got[11][3] == "allow"
    names = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("u@x.y.com:80",), ("10.0.3.4",), ("one",)], "host string").select("host", url_reputation.registered_domain(F.col("host")), url_reputation.suffix(F.col("host"))).collect()
    assert [tuple(r)[1:] for r in names] == [("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("y.com", "com"), ("10.0.3.4", "10.0.3.4"), ("one", "one")]
    none = spark.createDataFrame([], "host string, bad int")
    assert url_reputation.url_filter(pages, none).where("verdict = 'block'").count() == 2


# ---- 4


def test_license_scan(spark):
    rng = random.Random(3)
    docs = [prose(rng, 100) for _ in range(10)] + [None, "", "license", "Released under the MIT License.", prose(rng, 50) + "\nThis work is licensed under the GNU general public license version 3. " + prose(rng, 30), prose(rng, 5) + " licensed under CC BY-NC 4.0"]
    docs.append(prose(rng, 30_000) + " Licensed under the Apache License, Version 2.0.")
    got = {(r["doc_id"], r["license"]): r for r in license_scan.license_scan(table(spark, docs)).collect()}
    assert set(got) == {(13, "MIT"), (14, "GPL-3.0"), (15, "CC-BY-NC-4.0"), (16, "Apache-2.0")}
    both = "This work is licensed under the GNU General Public License, version 3. x y z Any work is licensed under the GNU General Public License, version 2."
    pair = {r["license"]: r for r in license_scan.license_scan(table(spark, [both, both + " " + both])).collect() if r["doc_id"] == 0}
    assert set(pair) == {"GPL-2.0", "GPL-3.0"} and pair["GPL-2.0"]["start"] > pair["GPL-3.0"]["end"]
    r = got[14, "GPL-3.0"]
    assert docs[14][r["start"] : r["end"]].startswith("This work") and r["dice"] == 1.0
    assert license_scan.license_scan(spark.createDataFrame([], SCHEMA)).count() == 0


# ---- 5


def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    places = {}
    for i in range(len(w) - 7):
        places.setdefault(tuple(w[i : i + 8]), []).append(i)
    repeated = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), len(w) < 20 or 100 * len(repeated) > 30 * len(w)


def test_quality_rules(spark, texts):
    rng = random.Random(6)
    more = [" ".join(w + "&&&$$$***" for w in prose(rng, 60).split()) for _ in range(3)] + ["\n".join(["same line", "\r", "same line", " x é\u00a0", "same line"]), "a b c d e f g h " * 4, "a " * 20]
    docs = texts + more
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(table(spark, docs)).collect()}
    for i, t in enumerate(docs):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_counts(t)
        assert not (r["base_failed"] and r["kept"])
    assert all(not got[len(texts) + k]["kept"] for k in range(3)) and all(got[i]["kept"] for i in range(60))
    assert quality_rules.quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0
    assert quality_rules.quality_rules(spark.createDataFrame([(1, "x " * 30, None, None)], "doc_id long, text string, lang string, source string")).count() == 1


def test_sketch_quantiles(spark):
    rows = [(i, prose(random.Random(i), 50) + " ####" * (i % 40), "en", "s") for i in range(400)]
    counts = quality_rules.measured(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    limit = quality_rules.thresholds(quality_rules.sketches(counts), prior=0.0, fences=0.0).first()["max_symbol_rate"]
    exact = np.quantile([r["n_symbols"] / r["n_words"] for r in counts.collect()], 0.75, method="inverted_cdf")
    assert exact > quality_rules.FEATURES["symbol_rate"][2] and limit == pytest.approx(exact, rel=0.03)


def test_limits_come_from_the_sketch_of_the_group(spark):
    rng = random.Random(26)
    plain = [prose(rng, 100) for _ in range(440)]
    few = [prose(rng, 99) + " " + "#" * (2 + k % 20) for k in range(40)]
    many = [prose(rng, 99) + " " + "#" * (40 + k) for k in range(40)]
    long = ["".join(prose(rng, 3).split()) + " " + " ".join("".join(prose(rng, 2).split()) for _ in range(99)) for _ in range(5)]
    rows = [(i, t, "en", "a" if i % 2 else "b") for i, t in enumerate(plain)] + [(1000 + i, t, "en", "a") for i, t in enumerate(few)] + [(2000 + i, t, "en", "b") for i, t in enumerate(many)] + [(3000 + i, t, "en", "a") for i, t in enumerate(long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    counts = quality_rules.measured(docs)
    limits = {r["source"]: r for r in quality_rules.thresholds(quality_rules.sketches(counts), prior=0.0).collect()}
    for source, part in (("a", few), ("b", many)):
        exact = np.quantile([t.count("#") / 100 for t in part], 0.5, method="inverted_cdf")
        assert limits[source]["max_symbol_rate"] == pytest.approx(exact, rel=0.03)
    failed = {r["doc_id"]: r["failed"] for r in quality_rules.quality_rules(docs, prior=20.0).collect()}
    assert failed[2000] == [] and "symbol_rate" in failed[1019] and "symbol_rate" in failed[2039]
    assert all(failed[3000 + i] == ["word_length"] for i in range(5))
    assert sum(bool(failed[i]) for i in range(440)) <= 4


def test_limits_are_shrunk_toward_the_language_and_have_both_ends(spark):
    rng = random.Random(36)
    rows = [(i, prose(rng, 60) + " ##" * (i % 4), "en", "a" if i % 10 else "b") for i in range(300)] + [(500 + i, prose(rng, 60), "fr", None) for i in range(40)]
    rows += [(900, " ".join("ab" for _ in range(30)) + " " + " ".join(f"a{chr(97 + k % 26)}" for k in range(60)), "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    sketch = quality_rules.sketches(quality_rules.measured(docs))
    own, every = ({(r["lang"], r["source"]): r for r in quality_rules.thresholds(sketch, prior=p).collect()} for p in (0.0, 1e12))
    half = {(r["lang"], r["source"]): r for r in quality_rules.thresholds(sketch, prior=100.0).collect()}
    by_lang = {(r["lang"]): r for r in quality_rules.thresholds(sketch.withColumn("source", F.lit("x")), prior=0.0).collect()}
    for (lang, source), r in half.items():
        n, m = sum(x[2:] == (lang, source) for x in rows), sum(x[2] == lang for x in rows)
        for c in ("max_symbol_rate", "max_word_length", "min_word_length"):
            of_lang = (m * by_lang[lang][c] + 100 * every[lang, source][c]) / (m + 100)
            assert r[c] == pytest.approx((n * own[lang, source][c] + 100 * of_lang) / (n + 100), rel=1e-6)
    failed = {r["doc_id"]: r["failed"] for r in quality_rules.quality_rules(docs).collect()}
    assert "low_word_length" in failed[900]


# ---- 6


def test_targets():
    t = source_mix.capped_targets({"a": 10, "b": 1000, "c": 1000, None: 0}, source_mix.cycled_weights(["b", "a", None, "c"]))
    assert t["a"] == 30 and t[None] == 0 and sum(t.values()) == pytest.approx(2010) and t["b"] / t["c"] == pytest.approx(2)


def test_flow_is_cheapest():
    flow = source_mix.route([(("a",), 100), (("a", "b"), 100), (("b",), 10)], {"a": 100, "b": 110})
    assert flow == [{"a": 100}, {"b": 100}, {"b": 10}]
    flow = source_mix.route([(("a",), 10), (("a", "b"), 10)], {"a": 30, "b": 30})
    assert sum(sum(f.values()) for f in flow) == 60 and flow[1].get("b") == 30


def test_mix(spark):
    rng = random.Random(7)
    docs = [prose(rng, rng.randint(1, 60)) for _ in range(600)] + [None, "", prose(rng, 5)]
    df = table(spark, docs, source=["b", None, "a", "é", "a"])
    one, two = ([tuple(r) for r in source_mix.mix_by_cycle(df.repartition(n)).orderBy("doc_id").collect()] for n in (1, 5))
    assert one == two and len(one) == len(docs)
    for s in {r[5] for r in one}:
        rows = [r for r in one if r[5] == s]
        assert sum(r[1] for r in rows) == rows[0][2] and abs(sum(r[4] for r in rows) - rows[0][3]) <= 60
        assert len({r[3] for r in rows}) == 1 and all(r[4] <= 3 * r[1] and (r[1] == 0 or r[4] % r[1] == 0) for r in rows)
    assert source_mix.mix_by_cycle(spark.createDataFrame([], SCHEMA)).count() == 0


def test_mix_overlapping_sources(spark):
    rows = [(i, 10, ["a"] if i % 3 == 0 else ["b"] if i % 3 == 1 else ["b", "a"]) for i in range(300)] + [(900, 5, [])]
    out = source_mix.mix_sources(spark.createDataFrame(rows, "doc_id long, size long, sources array<string>"), {"a": 1500.0, "b": 1500.0})
    assert abs(out.agg(F.sum("taken")).first()[0] - 3000) <= 20 and out.count() == 301 and out.where("taken > 3 * size").count() == 0


def test_texts_in_several_sources_are_taken_where_they_are_first_copies(spark, monkeypatch):
    rng = random.Random(35)
    shared, own = [prose(rng, 20) for _ in range(100)], [prose(rng, 20) for _ in range(300)]
    # weights 5 and 2: a has 200 shared and own texts and needs all its words, b has the shared texts and 200 own ones and needs few
    rows = [(i, t, "a") for i, t in enumerate(shared + own[:100])] + [(1000 + i, t, "b") for i, t in enumerate(shared + own[100:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r["doc_id"]: r for r in source_mix.mix_by_cycle(docs).collect()}
    for s in "ab":
        part = [r for r in out.values() if r["source"] == s]
        assert abs(sum(r["taken"] for r in part) - part[0]["target"]) <= 20 and all(r["taken"] <= 3 * r["size"] for r in part)
    twice = sum(out[i]["taken"] > 0 and out[1000 + i]["taken"] > 0 for i in range(100))
    assert twice == 0 and sum(out[1000 + i]["taken"] > 0 for i in range(100, 300)) > 100
    monkeypatch.setattr(source_mix, "MOST_PATTERNS", 0)
    folded = source_mix.mix_by_cycle(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect()
    assert all(abs(r["t"] - r["g"]) <= 20 for r in folded)


def test_flow_costs_no_more_than_any_other(spark):
    rng = random.Random(37)
    for _ in range(40):
        patterns = [(tuple(rng.sample("abc", rng.randint(1, 3))), rng.randint(1, 3)) for _ in range(3)]
        targets = {s: rng.randint(0, 4) for s in "abc"}
        flow = source_mix.route(patterns, targets)
        sent = lambda i: sum(flow[i].values())
        cost = lambda words, size: sum(max(0, min(size, words - k * size)) * c for k, c in enumerate((0, 1, 3)))
        # brute force over the words of each pattern and each source
        best = {tuple(0 for _ in "abc"): 0}
        for members, size in patterns:
            new = {}
            for got, c in best.items():
                for split in itertools.product(*(range(targets[s] + 1 if s in members else 1) for s in "abc")):
                    to = tuple(x + y for x, y in zip(got, split))
                    if sum(split) <= 3 * size and all(t <= targets[s] for t, s in zip(to, "abc")):
                        new[to] = min(new.get(to, 10**9), c + cost(sum(split), size))
            best = new
        most = max(map(sum, best))
        assert sum(map(sent, range(3))) == most
        assert sum(cost(sent(i), patterns[i][1]) for i in range(3)) == min(c for to, c in best.items() if sum(to) == most)


# ---- 7


def brute_spans(text):
    kinds = ("email", "ip", "card", "phone")
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(a, b, kinds[k]) for a, k, b in sorted(out)]


def test_base_spans_equal_the_patterns():
    rng = random.Random(9)
    fixed = ["a@b.c@d.e_x@y.z", "é x@y.zz, +1 (974) 555-3436.", "1.2.3.4.5.6.7.8", "256.1.1.1 001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "@", "a@b", "a@b..c", "+1((((", "1..2.3.4", "x@1.2.3.4", "+12345678901 2345"]
    for text in fixed + ["".join(rng.choice("a1 .-+@(9_%é5") for _ in range(rng.randint(1, 60))) for _ in range(4000)]:
        assert private_data.base_spans(text) == brute_spans(text), text


def test_private_data_over_the_corpus(spark):
    rng = random.Random(10)
    docs = [prose(rng, 60) for _ in range(60)]
    docs += [f"{prose(rng, 20)} zorblat mary@corp.example {prose(rng, 20)}" for _ in range(5)]
    docs += [f"{prose(rng, 10)} zorblat {prose(rng, 5)}", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', None, "", "9" * 50_000, "a@" * 20_000]
    out = {r["doc_id"]: r for r in private_data.private_spans(table(spark, docs)).collect()}
    assert all(out[i]["n_email"] == 1 and out[i]["n_removed"] == 1 for i in range(60, 65))
    assert out[65]["n_removed"] == 1 and out[66]["n_secret"] == 1 and out[67]["spans"] == out[68]["spans"] == ""
    assert all(out[i]["spans"] == "" for i in range(60))
    clean = {r["doc_id"]: r["text"] for r in private_data.sanitise(table(spark, docs)).collect()}
    assert "mary" not in clean[60] and "[EMAIL]" in clean[60] and "zorblat" not in clean[65] and clean[0] == docs[0] and clean[67] is None
    assert private_data.private_spans(spark.createDataFrame([], SCHEMA)).count() == 0


def test_terms_of_rare_entities_over_the_whole_text(spark):
    rng = random.Random(28)
    plain = [prose(rng, 60) for _ in range(1500)]
    docs = plain + ["quixnard " + prose(rng, 20) + " ann@corp.example", *("vlimpet " + prose(rng, 15) + " joe@corp.example " + prose(rng, 15) for _ in range(2))]
    out = {r["doc_id"]: r for r in private_data.private_spans(table(spark, docs)).collect()}
    assert [out[1500 + k]["spans"].split(",")[0] for k in range(3)] == ["term:0:8", "removed:0:7", "removed:0:7"]
    assert [out[1500 + k]["n_term"] for k in range(3)] == [1, 0, 0] and [out[1500 + k]["n_removed"] for k in range(3)] == [0, 1, 1] and all(out[i]["n_term"] == 0 for i in range(1500))


def test_disclosing_terms_equal_brute_force_and_spare_clean_documents(spark):
    import math

    rng = random.Random(34)
    docs = [prose(rng, 30) for _ in range(700)] + [f"{prose(rng, 8)} only{k}x joint{k // 3}y wide{k // 6}z u{k // 3}@corp.example {prose(rng, 8)}" for k in range(24)] + ["wide0z", "joint1y"] * 2 + [None, ""]
    words = [set((t or "").lower().split()) for t in docs]
    count, pair, whose = {}, {}, {}
    for w in words:
        for t in w:
            count[t] = count.get(t, 0) + 1
        for e in (x for x in w if "@" in x):
            whose[e] = whose.get(e, 0) + 1
            for t in w:
                if "@" not in t:
                    pair[e, t] = pair.get((e, t), 0) + 1
    want, total = {}, len(docs)
    for (e, t), n_et in pair.items():
        n_terms, a, p = sum(x == e for x, _ in pair), n_et / whose[e], count[t] / total
        kl = a * math.log(a / p) + ((1 - a) * math.log((1 - a) / (1 - p)) if a < 1 and p < 1 else 0)
        lacking = -math.log2(n_et / (count[t] + 1))
        if lacking <= 1 and math.log(n_terms) - whose[e] * kl <= math.log(0.05):
            want[t] = want.get(t, False) or lacking <= 0.6
    assert want and True in want.values() and False in want.values()
    got = {r["term"]: r["removed"] for r in private_data.disclosing_terms(table(spark, docs)).collect()}
    key = {int(h): t for t in want for h in private_data.Words(*private_data.text_buffer(__import__("pyarrow").array([t]))).hash.view(np.int64)}
    assert {key[h]: r for h, r in got.items()} == want
    spans = {r["doc_id"]: r for r in private_data.private_spans(table(spark, docs)).collect()}
    assert all(spans[i]["spans"] == "" for i in range(700)) and spans[725]["n_term"] == 1 and spans[703]["n_removed"] == 0 < spans[703]["n_term"]
    text = private_data.sanitise(table(spark, docs)).where("doc_id = 700").first()["text"]
    assert "joint0y" not in text and "[EMAIL]" in text


def test_more_terms_than_fit_in_memory(spark, monkeypatch):
    rng = random.Random(29)
    docs = [prose(rng, 40) for _ in range(400)] + [f"{prose(rng, 9)} odd{k}x {prose(rng, 9)} u{k}@corp.example rare{k}y" for k in range(8)] + [None, "", "odd1x é rare3y"] * 2
    df = table(spark, docs)
    read = lambda: (sorted(map(str, private_data.private_spans(df).collect())), sorted(map(str, private_data.sanitise(df).collect())))
    want = read()
    assert sum("n_term=2" in r for r in want[0]) == 6
    monkeypatch.setattr(private_data, "IN_MEMORY", 5)
    assert read() == want


# ---- 8


def test_quality_classifier(spark):
    rng = random.Random(11)
    good = [prose(rng, 60) for _ in range(150)]
    bad = [" ".join(w.upper() + "!!" for w in prose(rng, 60).split()) for _ in range(150)]
    docs = [None, "", "a" * 30_000] + [x for p in zip(good, bad) for x in p]
    labels = spark.createDataFrame([(i, (i - 3) % 2 ^ 1, 0) for i in range(3, len(docs))] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality_model.quality_classifier(table(spark, docs), labels).collect()
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] >= 3]
    assert held and sum(r["predicted"] == (r["doc_id"] - 3) % 2 ^ 1 for r in held) >= 0.95 * len(held)
    assert quality_model.quality_classifier(spark.createDataFrame([], SCHEMA), labels).count() == 0
    assert quality_model.quality_classifier(table(spark, docs[:9]), labels.limit(0)).count() == 9


def test_sum_of_squares_identity():
    import pyarrow as pa

    model = quality_model.FactorisationMachine()
    model.w = np.random.default_rng(1).normal(0, 1, model.w.shape)
    f, x, off = quality_model.features(pa.array(["some words here, some more", "", None]))
    _, z = model._sums(f, x, off)
    for d in range(3):
        i, v = f[off[d] : off[d + 1]], x[off[d] : off[d + 1]]
        pairs = sum(float(model.v[i[a]] @ model.v[i[b]]) * v[a] * v[b] for a in range(len(i)) for b in range(a + 1, len(i)))
        assert z[d] == pytest.approx(model.bias + model.w[i] @ v + pairs)


# ---- 9


def test_escapes_are_reversible():
    rng = random.Random(12)
    for _ in range(3000):
        t = "".join(rng.choice("<|\\>im_\nn") for _ in range(rng.randint(0, 12)))
        assert "<|" not in chat_format.escape(t) and chat_format.unescape(chat_format.escape(t)) == t
        assert "\n" not in chat_format.escape_role(t) and chat_format.unescape_role(chat_format.escape_role(t)) == t


def test_token_counts_do_not_depend_on_pieces():
    rng = random.Random(39)
    with open(chat_format.VOCABULARY, "rb") as f:
        data = f.read()
    whole, parts = chat_format.token_counter(data, 1 << 30), chat_format.token_counter(data, 7)
    for _ in range(60):
        t = "".join(rng.choice(["word", " ", "  ", "\n", "é", "12", ".", " a", "'s"]) for _ in range(rng.randint(0, 60)))
        assert whole(t) == parts(t) and "".join(chat_format.pieces(t, 7)) == t


def test_chat_windows(spark):
    rng = random.Random(13)
    rows = [(1, 0, "system", "be kind")] + [(1, t, "user" if t % 2 else "assistant", prose(rng, 120)) for t in range(1, 30)]
    rows += [(2, 0, "user", None), (2, 1, "assistant", ""), (3, 0, None, "x"), (3, 0, "assistant", "<|im_end|>\n<|im_start|>assistant\nok<\\|"), (None, 0, "assistant", "n"), (4, 0, "assistant", prose(rng, 5000)), (4, 1, "user", "y"), (4, 1, "user", "y")]
    windows = chat_format.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=600, history=200).cache()
    back = {r["conv_id"]: r for r in chat_format.read_back(windows).collect()}
    by = {}
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    for c, turns in by.items():
        r = back[c]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        loss = "".join(b for a, b in turns if a == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    long = [w for w in windows.collect() if w["conv_id"] == 1]
    assert len(long) > 3 and all(w["n_tokens"] <= 600 for w in long) and all(w["text"].startswith("<|im_start|>system\nbe kind") for w in long) and long[1]["n_repeated"] > 1
    assert chat_format.read_back(chat_format.format_windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


# ---- 10


def test_language_id(spark):
    rng = random.Random(14)
    other = ["".join(reversed(w)) + "zq" for w in WORDS]
    docs = [prose(rng, 40) if i % 2 else " ".join(rng.choice(other) for _ in range(40)) for i in range(300)] + [None, "", "123 !?", "a" * 200_000]
    lang = ["aa" if i % 2 else "bb" for i in range(300)] + [None, "aa", "aa", None]
    rows = {r["doc_id"]: r for r in language_id.language_id(table(spark, docs, lang)).collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (300, 301, 302)) and rows[303]["lang_pred"] in ("aa", "bb")
    held = [i for i in range(300) if rows[i]["held_out"]]
    assert held and sum(rows[i]["lang_pred"] == lang[i] for i in held) >= 0.95 * len(held)
    assert language_id.language_id(spark.createDataFrame([], SCHEMA)).count() == 0
    assert language_id.language_id(table(spark, docs[:4], [None] * 4)).where("lang_pred = 'und'").count() == 4


def test_gradients_by_difference():
    model = language_id.BytesGru(["a", "b"], hidden=3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rng = np.random.default_rng(3)
    x, used, y = rng.integers(97, 101, (5, 7)).astype(np.uint8), np.array([7, 7, 4, 7, 1]), np.array([0, 1, 0, 1, 1])
    _, grad = model.gradients(x, used, y)
    for name in ("out", "bias", "u", "table"):
        for at in np.ndindex(*model.p[name].shape):
            if name == "table" and not 97 <= at[-1] <= 100:
                assert grad[name][at] == 0
                continue
            save, loss = model.p[name][at], []
            for e in (1e-3, -1e-3):
                model.p[name][at] = save + e
                loss.append(model.gradients(x, used, y)[0])
            model.p[name][at] = save
            assert grad[name][at] == pytest.approx((loss[0] - loss[1]) / 2e-3, rel=0.02, abs=2e-5), (name, at)


def test_windows_give_what_a_run_over_the_whole_text_gives():
    rng = random.Random(38)
    model = language_id.BytesGru(["a", "b", "c"])
    texts = ["", "x", prose(rng, 31), prose(rng, 700), "é" * 300]
    data = [t.encode() for t in texts]
    buf, off = np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(d) for d in data])))
    got = model.pooled(buf, off)
    for d, mean in zip(data, got):
        if d:
            edge = language_id.EDGE
            x = np.concatenate((np.zeros(edge, np.uint8), np.frombuffer(d, np.uint8), np.zeros(edge, np.uint8)))[None, :]
            prob = model.softmax(model.logits(x)[edge:-edge])[:, :, 0]
            assert mean == pytest.approx(prob.mean(axis=0), abs=0.01)


def test_samples_are_bounded_with_null_and_repeated_ids(spark):
    from arborlog.llm.textkit import sample_keys

    rows = [(None, f"text {i}", "aa") for i in range(500)] + [(1, "same", "aa")] * 300 + [(i, "t", "bb") for i in range(50)] + [(9, "z", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    count = {r["lang"]: r["count"] for r in sample_keys(df.where("lang is not null"), 100, "lang").groupBy("lang").count().collect()}
    assert count == {"aa": 100, "bb": 50} and sample_keys(df, 100).count() == 100 and sample_keys(df.limit(0), 5).count() == 0


# ---- pipeline


def test_pipeline_keeps_columns_and_clean_documents(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(15)
    items = [prose(rng, 30) for _ in range(3)]
    docs = [prose(rng, 80) for _ in range(60)] + [None, "", "!!! 123"]
    docs += [docs[0], edited(rng, docs[1], 1), prose(rng, 20) + " " + items[0] + " " + prose(rng, 20), prose(rng, 30) + " mail bob@corp.example now"]
    df = table(spark, docs)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = []
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = corpus_pipeline.written(f(spark, stage, str(tmp_path)))
        assert stage.columns == df.columns
        left.append({r["doc_id"] for r in stage.select("doc_id").collect()})
    clean = set(range(60))
    assert left[0] == clean | {63, 64, 65, 66} and left[1] == clean | {65, 66} and left[2] == clean | {66} == left[3]
    assert "bob@" not in stage.where("doc_id = 66").first()["text"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 61


def test_pipeline_with_null_ids_repeats_clashing_columns_and_an_empty_table(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(40)
    item, same = prose(rng, 30), prose(rng, 70)
    rows = [(i, prose(rng, 60), "en", "s", 1, "x", 0.5) for i in range(40)]
    rows += [(None, same, "en", "s", 1, "x", 0.5)] * 2 + [(50, same, None, None, 1, "x", 0.5)] * 2 + [(None, item, "en", "s", 1, "x", 0.5), (60, None, "en", "s", 1, "x", 0.5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, __lang string, __score double"
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for part, want in ((rows, [*range(40), 50]), ([], [])):
        stage = spark.createDataFrame(part, schema)
        stage.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        for _, f in corpus_pipeline.STAGES[:-1]:
            stage = corpus_pipeline.written(f(spark, stage, str(tmp_path)))
            assert stage.columns == [c.split()[0] for c in schema.split(", ")]
        assert sorted(r["doc_id"] for r in stage.collect()) == want
        assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(want)
