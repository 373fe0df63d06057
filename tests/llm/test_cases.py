"""Nulls, empty and long texts, ties and repeats, empty tables and clashing column names, for each operator."""

import math
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelf.llm import common, decontam, hmm, licenses, mixing, quality, repeats, sharding, simhash, urls, warc
from tests.llm.packing import pack

SCHEMA = "doc_id long, text string, source string, row string, size long, quality string, _words string, hits string, licenses string, shard int"
LONG = " ".join(f"w{i}" for i in range(60_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))


def rows(*texts):
    return [(i, t, ("a", "b", None)[i % 3], "r", 7, "q", "w", "h", "l", 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    odd = rows(None, "", "   \n\t ", "one", LONG, PASSAGE, f"before {PASSAGE} after", LONG)
    odd += [(None, "no id", "a", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None), odd[3], odd[3], odd[5]]
    return spark.createDataFrame(odd, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mix(docs, none):
    got = mixing.mix(docs, common.n_words(F.col("text"))).collect()
    assert len(got) == docs.count()
    by_source = {}
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] + r["part"] and 0 <= r["part"] <= r["size"] and r["taken"] <= 3 * r["size"]
        by_source.setdefault(r["source"], []).append(r)
    for rs in by_source.values():
        assert sum(r["size"] for r in rs) == rs[0]["source_size"]
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= 0.5
    assert set(by_source) == {"a", "b", None}
    assert sorted(mixing.mix(docs, common.n_words(F.col("text"))).select("id", "size", "taken").collect(), key=str) == sorted(
        [(r["id"], r["size"], r["taken"]) for r in got], key=str
    )
    assert mixing.mixed(docs, common.n_words(F.col("text"))).columns == docs.columns
    assert mixing.mix(none, F.lit(1)).count() == 0


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 1, "b": 1, "c": 1}, {"a": 100, "b": 1, "c": 50, "d": 3}, {"a": 0, "b": 0}, {None: 5, "z": 5}])
def test_targets_share_by_weight_up_to_the_cap(spark, sizes):
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, left, open_ = {}, float(sum(sizes.values())), set(order)
    while open_:
        rate = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * rate >= 3 * sizes[s]}
        for s in full or open_:
            want[s] = 3.0 * sizes[s] if full else weight[s] * rate
            left -= want[s]
        open_ = open_ - full if full else set()
    assert got == pytest.approx(want)


def test_shards(spark, docs, none):
    got = sharding.assign(docs, F.md5(F.coalesce(F.col("text"), F.lit(""))), shards=4).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == [(i % 4, i // 4) for i in sorted(range(len(got)), key=lambda i: (i % 4, i))]
    assert sorted(str(r["row"]["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in docs.collect())
    assert sharding.assign(none, F.col("text")).count() == 0
    alone = sharding.assign(docs, F.lit(None).cast("string"), shards=3).groupBy("shard").count().collect()
    assert max(r["count"] for r in alone) - min(r["count"] for r in alone) <= 1


def test_hot_link_fills_shards_within_quotas(spark):
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1500, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"))
    got = sharding.assign(hot, F.col("k"), shards=10)
    counts = got.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("row.k") == "hot", 1)).alias("hot"), F.max("slot").alias("top")).collect()
    assert all(r["n"] == 300 and r["top"] == 299 for r in counts)
    assert sum(r["hot"] > 0 for r in counts) <= 6  # five shards hold it; one more may keep a rest


@pytest.mark.parametrize("rows, mates, split", [(800, 2, 0), (900, 3, 0), (1010, 2, 2), (804, 4, 1)])
def test_copies_stay_together_where_all_rows_have_one(spark, rows, mates, split):
    docs = spark.range(rows).select(F.col("id").alias("doc_id"), (F.col("id") % (rows // mates)).cast("string").alias("k"))
    got = sharding.assign(docs, F.col("k"), shards=4 if split else 10).collect()
    homes, seats = {}, {}
    for r in got:
        homes.setdefault(r["row"]["k"], set()).add(r["shard"])
        seats.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == rows and max(map(len, seats.values())) - min(map(len, seats.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in seats.values())
    assert sum(len(h) > 1 for h in homes.values()) <= split


@pytest.mark.parametrize("sizes, quotas, split", [
    ({2: 8}, [4, 4, 4, 4], 0), ({3: 2, 2: 4}, [7, 7], 0), ({3: 2, 2: 3}, [6, 6], 0), ({2: 5}, [5, 5], 1), ({25: 1, 2: 5}, [10, 10, 10, 10], 1),
    ({7: 3, 5: 4, 2: 30}, [25, 25, 25, 26], 1), ({}, [3, 3], 0),
])
def test_pack(sizes, quotas, split):
    parts, loads = {}, [0] * len(quotas)
    for size, begin, end, shard, n in pack(sizes, quotas):
        for k in range(begin, end):
            parts.setdefault((size, k), []).append(n)
            loads[shard] += n
    assert sorted(parts) == sorted((s, k) for s, n in sizes.items() for k in range(n))
    assert all(sum(ns) == s for (s, _), ns in parts.items()) and all(n <= q for n, q in zip(loads, quotas))
    assert sum(len(ns) > 1 for ns in parts.values()) <= split


@pytest.mark.parametrize("mates", [2, 3, 7])
def test_propagation_from_hash_placement(spark, mates):
    """Every row starts in a shard by hash, all shards are full: loads stay, cut edges fall each round and few groups stay split."""
    shards, rows = 8, 8 * 126
    at = F.row_number().over(Window.orderBy(F.md5(F.col("id").cast("string")))) - 1
    start = spark.range(rows).select((F.col("id") % (rows // mates)).cast("string").alias("link"), (at % shards).cast("int").alias("shard"))
    start = common.saved(start.groupBy("link", "shard").agg(F.count(F.lit(1)).alias("n")), "test-start")
    log = [{"cut": sharding.cut_edges(start), "moved": 0}]
    quotas = [rows // shards] * shards
    end = sharding.propagate(start, quotas, log=log)
    assert len(log) > 2 and all(b["cut"] < a["cut"] and b["moved"] > 0 for a, b in zip(log, log[1:]))
    parts = end.collect()
    loads, homes = Counter(), Counter()
    for r in parts:
        loads[r["shard"]] += r["n"]
        homes[r["link"]] += 1
    assert [loads[j] for j in range(shards)] == quotas and sum(r["n"] for r in parts) == rows
    best = sum(n > 1 for n in Counter((size, k) for size, b, e, _, _ in pack({mates: rows // mates}, quotas) for k in range(b, e)).values())
    assert best == 0 and sum(n > 1 for n in homes.values()) <= shards
    assert log[-1]["cut"] <= 0.05 * log[0]["cut"]


@pytest.mark.parametrize("asked, room, moved", [
    ({(0, 1): 5, (1, 0): 3}, [0, 0], 6), ({(0, 1): 5, (1, 2): 4, (2, 0): 2}, [0, 0, 0], 6), ({(0, 1): 5}, [0, 2], 2), ({(0, 1): 5, (1, 2): 5}, [0, 0, 5], 10),
    ({(0, 1): 4}, [9, 0], 0), ({}, [1], 0),
])
def test_granted_moves_keep_quotas(asked, room, moved):
    given = sharding.granted(asked, room)
    assert sum(given.values()) == moved and all(n <= asked[a] for a, n in given.items())
    for j, free in enumerate(room):
        assert sum(n for (_, t), n in given.items() if t == j) - sum(n for (f, _), n in given.items() if f == j) <= free


def test_quality(docs, none):
    got = quality.measured(docs)
    assert got.columns == [*docs.columns, "quality_"]
    for r in got.collect():
        q, n = r["quality_"], len((r["text"] or "").split())
        assert q["n_words"] == n and q["word_chars"] == sum(map(len, (r["text"] or "").split()))
        assert q["base_failed"] == (n < 50) and not q["kept"]  # no stop words here
    assert quality.kept(docs).columns == docs.columns
    assert quality.measured(none).count() == 0


@pytest.mark.parametrize("text", ["a b c a b c", "x " * 20, "a b c d\na b c d\n\n \na b", "b a\tb a\x0bb", "1 2 3 4 5 6 1 2 3"])
def test_repeats_and_lines(spark, text):
    q = quality.measured(spark.createDataFrame([(text,)], "text string")).first()["quality"]
    w = text.split()
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if x.strip()]
    assert (q["n_repeat_words"], q["n_dup_lines"]) == (len(hit), len(lines) - len(set(lines)))


def test_lm(docs, none):
    got = hmm.scored(docs).collect()
    assert len(got) == docs.count() and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert {r["n_tokens"] for r in got if r["id"] in (0, 1, 2)} == {1}
    assert hmm.scored(none).count() == 0
    assert all(math.isfinite(r["score"]) for r in hmm.scored(docs.filter("doc_id is null")).collect())  # all held out


def brute(texts, window):
    words = [(t or "").split() for t in texts]
    starts = {}
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            starts.setdefault(tuple(w[i : i + window]), []).append((d, i))
    lost = [set() for _ in words]
    for places in starts.values():
        if len(places) > 1:
            for d, i in places:
                lost[d].update(range(i, i + window))
    return [(len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)) for w, gone in zip(words, lost)]


def test_repeated_windows(spark, docs, none):
    import hashlib
    import random

    rng = random.Random(5)
    texts = [r["text"] for r in docs.collect()]
    small = [" ".join(rng.choice("ab") for _ in range(rng.randrange(0, 90))) for _ in range(40)]
    large = [" ".join(str(rng.randrange(50)) for _ in range(200)) for _ in range(20)]
    large = [f"{large[i][: rng.randrange(400)]} {large[rng.randrange(20)][rng.randrange(300) :]}" for i in range(20)]
    texts += small + large + ["z " * 100, "y " * 34, "y " * 35, "q w e " * 40, f"m {'q w e ' * 30} n"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: tuple(r)[1:] for r in repeats.deduplicated(frame).collect()}
    want = {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, (n, gone, kept) in enumerate(brute(texts, 35))}
    assert got == want
    assert repeats.deduplicated(docs).count() == docs.count() and repeats.deduplicated(none).count() == 0


def test_simhash(spark, docs, none):
    got = simhash.grouped(docs, docs.columns).collect()
    assert len(got) == docs.count()
    firsts = {r["row"]["doc_id"]: r["first"]["id"] for r in got if r["row"]["doc_id"] is not None}
    assert firsts[0] == firsts[1] == firsts[2] == 0 and firsts[7] == 4 and firsts[3] == 3
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None).count(3) == 1
    assert simhash.deduplicated(none).count() == 0


def test_hot_key_is_tiled(spark, monkeypatch):
    import random

    rng = random.Random(3)
    base = rng.getrandbits(63)
    nodes = [(i, base ^ sum(1 << b for b in rng.sample(range(60), 2)), 0) for i in range(400)] + [(400 + i, rng.getrandbits(63), 0) for i in range(100)]
    classes = spark.createDataFrame(nodes, "node long, a long, b long")
    want = {frozenset(r) for r in _parts([(r["a"], r["b"]) for r in simhash.links(classes, 4, 128).collect()])}
    monkeypatch.setattr(simhash, "TILE", 30)
    assert {frozenset(r) for r in _parts([(r["a"], r["b"]) for r in simhash.links(classes, 4, 128).collect()])} == want
    edges = [(x[0], y[0]) for i, x in enumerate(nodes) for y in nodes[:i] if (x[1] ^ y[1]).bit_count() <= 4]
    assert {frozenset(r) for r in _parts(edges)} == want


def test_near_dedup_against_all_pairs(spark, monkeypatch):
    import random

    rng = random.Random(5)

    def edited(words, n):
        at = set(rng.sample(range(len(words)), n))
        return [f"n{rng.random()}" if i in at else w for i, w in enumerate(words)]

    texts = []
    for size in (40, 120, 400):
        for share in (0.01, 0.015, 0.02, 0.025, 0.03, 0.04, 0.05, 0.06):
            for _ in range(5):
                base = [f"b{rng.random()}" for _ in range(size)]
                texts += [base, edited(base, max(1, round(share * size)))]
    base = [f"b{rng.random()}" for _ in range(200)]
    family = [edited(base, 4) for _ in range(60)]  # each near 0.8 to the base and near 0.65 to the others
    texts += [*family[:30], base, *family[30:], *[edited(family[0], 2) for _ in range(20)], ["few", "words"], ["few", "words"]]
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    edges = [(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    assert len(edges) > 60
    want = sorted({*range(len(texts))} - {i for part in _parts(edges) for i in part if i != min(part)})
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.deduplicated(docs).collect()) == want
    monkeypatch.setattr(simhash, "SETS", 10)
    assert sorted(r["doc_id"] for r in simhash.deduplicated(docs).collect()) == want


def _parts(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    out = {}
    for x in list(root):
        out.setdefault(find(x), set()).add(x)
    return out.values()


def test_components(spark):
    import random

    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(500, 500)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for part in _parts([e for e in edges if e[0] != e[1]]):
        assert all(got.get(x, x) == min(part) for x in part)


@pytest.mark.parametrize("least", [0, 5])
def test_warc(spark, least):
    pages = spark.createDataFrame(
        [(3, "http://a/\r\nX: y", "same page", "x"), (1, None, "same page", "x"), (2, "http://b/é", None, None), (5, "u", "", "x"), (4, "u", "tiny", None),
         (6, "u", "tiny", "x"), (None, "u", "tiny", "x"), (1, "again", "same page", "x"), (9, "u", LONG, "x")],
        "page_id long, url string, html string, sha string",
    )
    archives = warc.write(pages, min_bytes=least)
    got = warc.read(archives).collect()
    assert archives.agg(F.sum("records")).first()[0] == len(got) == 9
    by = {}
    for r in got:
        by.setdefault(r["record_id"], []).append(r)
    assert [r["record_type"] for r in by["1"]] == ["response"] * 2 and (by["3"][0]["record_type"], by["3"][0]["refers_to"], by["3"][0]["payload"]) == ("revisit", "1", None)
    assert by["3"][0]["payload_bytes"] == 9 and by["3"][0]["payload_digest"] == by["1"][0]["payload_digest"] == warc.digest(b"same page")
    assert by["6"][0]["refers_to"] == (None if least else "4") and by["9"][0]["payload"].decode() == LONG
    assert by["5"][0]["refers_to"] == (None if least else "2") and by[None][0]["payload_bytes"] == 4
    assert warc.read(warc.write(pages.filter("page_id > 99"))).count() == 0


def test_archives_are_read_by_several_tasks(spark):
    pages = spark.range(240).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.col("id").cast("string").alias("html")).repartition(12)
    archives = warc.write(pages)
    assert archives.count() == 12
    tasks = warc.read(archives).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) > 4 and sum(r["count"] for r in tasks) == 240


def test_warc_reader_checks_digests():
    import gzip
    import io

    good = warc.record("1", "u", b"payload", None, False)
    assert [r["payload"] for r in warc.records(io.BytesIO(gzip.compress(good) + gzip.compress(good)))] == [b"payload"] * 2
    for bad in (good.replace(b"\r\n\r\npayload", b"\r\n\r\nPayload"), good[:-4], good + b"x"):
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(gzip.compress(bad))))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(gzip.compress(good)[:-20])))


def test_licenses(docs, none):
    got = licenses.scanned(docs)
    assert got.columns == [*docs.columns, "licenses_"] and all(r["licenses_"]["matches"] == [] for r in got.collect())
    assert licenses.scanned(none).count() == 0 and licenses.scanned(docs, []).count() == docs.count()


@pytest.mark.parametrize("name, text", licenses.TEMPLATES)
def test_each_template_is_found_in_any_place(name, text):
    library = licenses.Library(licenses.TEMPLATES)
    for lead in (0, 1, 5, 63, 4090, 9000):
        whole = f"{'lead ' * lead}{text.upper()} {'tail ' * 40}"
        found = {m["template"]: m for m in library.scan(whole, 0.8)["matches"]}
        assert found[name]["first_word"] == lead


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([("i1", PASSAGE), ("i2", "ONE"), ("i3", None), ("i4", "..."), (None, "no id"), ("i1", PASSAGE)], "item_id string, text string")
    got = decontam.contaminated(docs, items)
    assert got.columns == [*docs.columns, "hits_"]
    for r in got.collect():
        want = {"one": (1, ["i2"]), PASSAGE: (60, ["i1"]), f"before {PASSAGE} after": (60, ["i1"])}.get(r["text"], (0, []))
        assert (r["hits_"]["n_hit"], r["hits_"]["items"]) == want
        for s in r["hits_"]["spans"]:
            assert r["text"][s["start"] : s["end"]] in ("one", PASSAGE)
    blocks = decontam.contaminated(docs, items, block_words=1).select("doc_id", "hits_").collect()
    assert sorted(map(str, blocks)) == sorted(map(str, got.select("doc_id", "hits_").collect()))
    assert decontam.clean(docs, items.limit(0)).count() == docs.count() and decontam.clean(none, items).count() == 0


def test_spans_are_of_the_original_text(spark):
    docs = spark.createDataFrame([("Ünï—x! Ça: va, BIEN mon/ami «ß» und 1 2 3 4 ende ü",)], "text string")
    items = spark.createDataFrame([("k", "bien MON ami «ß» und 1 2 3 4 ende")], "item_id string, text string")
    hits = decontam.contaminated(docs, items).first()["hits"]
    assert [docs.first()["text"][s["start"] : s["end"]] for s in hits["spans"]] == ["BIEN mon/ami «ß» und 1 2 3 4 ende"]


def test_urls(spark):
    rules = [("block", "net", "/"), ("allow", "a.net", "/en/"), ("block", "a.net", "/en/x"), ("allow", "b.a.net", ""), ("block", "b.a.net", ""), ("allow", None, "/"), ("block", "org", "/q")]
    cases = {
        "http://NET/": ("net", "/", "net/", "block"), "http://x.net": ("x.net", "", None, "allow"), "ftp://a.net/en/y?z": ("a.net", "/en/y", "a.net/en/", "allow"),
        "http://c.a.net/en/xy#f": ("c.a.net", "/en/xy", "a.net/en/x", "block"), "http://b.a.net/en/x": ("b.a.net", "/en/x", "a.net/en/x", "block"),
        "http://b.a.net?u": ("b.a.net", "", "b.a.net", "block"), "http://aa.net/en/": ("aa.net", "/en/", "net/", "block"), "http://org/q1": ("org", "/q1", "org/q", "block"),
        None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "http://": ("", "", None, "allow"), "http://a.net./en/": ("a.net.", "/en/", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate(cases)] * 2, "page_id long, url string, host string, key string")
    got = urls.judged(pages, spark.createDataFrame(rules, urls.RULE_SCHEMA)).collect()
    assert len(got) == 2 * len(cases)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == list(cases.values())[r["id"]]
    assert urls.judged(pages.limit(0), spark.createDataFrame(rules, urls.RULE_SCHEMA)).count() == 0
    assert {r["verdict"] for r in urls.judged(pages, spark.createDataFrame([], urls.RULE_SCHEMA)).collect()} == {"allow"}


def test_hot_host_takes_its_rules_into_every_part(spark):
    pages = spark.range(2000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://hot.example.net/de/"), F.col("id").cast("string")).alias("url"))
    rules = spark.createDataFrame([("block", "net", "/"), ("allow", "hot.example.net", "/de/1")], urls.RULE_SCHEMA)
    got = {r["id"]: r["verdict"] for r in urls.judged(pages, rules).collect()}
    assert got == {i: "allow" if str(i).startswith("1") else "block" for i in range(2000)}
