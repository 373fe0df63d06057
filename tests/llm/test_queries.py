"""The operators' queries beside their SQL, or beside brute force where SQL can't express them."""

import math
import re
import zlib
from collections import Counter

import pytest
import xxhash

from shelf.llm import hmm, licenses
from shelf.llm.decontam import words as folded
from shelf.llm.queries import ORACLES, QUERIES
from tests.compare import compare, connect

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def texts(spark):
    return {r[0]: r[1] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.mark.parametrize("name", sorted(ORACLES.keys() - {"pipeline"}))
def test_matches_sql(spark, con, name):
    if ORACLES[name] is not None:
        diff, _ = compare(spark, con, SF, QUERIES[name], ORACLES[name])
        assert diff is None


def groups(prints, near):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if near(prints[a], prints[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def fingerprint(text, size, seed=42):
    w = WORD.findall(lowered(text))
    shingles = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_all_pairs(spark, texts):
    prints = {d: fingerprint(t, 4) for d, t in texts.items()}
    want = groups(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op6_simhash"](spark, SF).collect()}
    assert got == {d: (f"{prints[d]:016x}", want[d]) for d in texts}


def test_lm_base_and_gain(spark, texts):
    tokens = {d: [*WORD.findall(lowered(t)), None] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in texts}
    counts = Counter(w for d, t in tokens.items() if not held[d] for w in t)
    total, kinds = sum(counts.values()), len(counts)
    rows = {r["doc_id"]: r for r in QUERIES["op4_lm_scoring"](spark, SF).collect()}
    assert rows.keys() == tokens.keys()
    for d, t in tokens.items():
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in t)
        assert rows[d]["base_score"] == pytest.approx(base, rel=1e-9)
        assert (rows[d]["n_tokens"], rows[d]["n_known"], rows[d]["train_tokens"], rows[d]["held_out"]) == (
            len(t), sum(w in counts for w in t), total, held[d]
        )
    out = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > 0.9 * sum(r["base_score"] for r in out)


def test_lm_score_is_the_sum_over_all_paths(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "b a a", "c", "", "a c b d"])], "doc_id long, text string")
    coded, classes, model = hmm.fitted(docs, states=2, rounds=2)
    rows = {r["id"]: r for r in coded.collect()}
    for r in hmm.scored(docs, states=2, rounds=2).collect():
        kinds = [*hmm.unplaned(rows[r["id"]]["codes"], "u2").tolist(), classes.end]
        paths = 0.0
        for path in range(2 ** len(kinds)):
            z = [path >> i & 1 for i in range(len(kinds))]
            p = float(model.start[z[0]]) * float(model.emit[kinds[0], z[0]])
            for i in range(1, len(z)):
                p *= float(model.move[z[i - 1], z[i]]) * float(model.emit[kinds[i], z[i]])
            paths += p
        assert r["score"] == pytest.approx(math.log10(paths) + rows[r["id"]]["inner"], abs=1e-4)
    assert model.emit.sum(axis=0) == pytest.approx([1, 1], abs=1e-4)


def test_licenses_against_every_window(spark, texts):
    library = licenses.Library(licenses.TEMPLATES)
    got = {r["doc_id"]: r for r in QUERIES["op8_license_scans"](spark, SF).collect()}
    for d, t in texts.items():
        h = licenses.shingles(folded(t))
        want = set()
        for name, have in zip(library.names, library.sets):
            size = 1 << (len(have) - 1).bit_length()
            if any(len(set(h[i : i + 2 * size].tolist()) & have) >= 0.8 * len(have) for i in range(0, max(1, len(h) - size), size)):
                want.add(name)
        assert set(filter(None, got[d]["templates"].split(","))) == want
        assert got[d]["n_words"] == len(folded(t))


def test_shards_are_even_and_keep_copies_together(spark, texts):
    rows = QUERIES["op2_sharding"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    seats = {}
    homes = {}
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "rows", None)
        seats.setdefault(r["shard"], []).append(r["slot"])
        homes.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert set(seats) == set(range(40)) and max(map(len, seats.values())) - min(map(len, seats.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in seats.values())
    assert all(len(s) == 1 for s in homes.values())


def shingles(text):
    w = WORD.findall(lowered(text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def test_pipeline_against_its_rules(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    source = {r["doc_id"]: r for r in docs.collect()}
    step = docs
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, SMALL)
        kept.append(sorted(r["doc_id"] for r in step.collect()))
        if name != "sharding":
            assert step.columns == docs.columns
    good = sorted(r["doc_id"] for r in QUERIES["op3_quality_rules"](spark, SMALL).collect() if r["kept"])
    assert kept[0] == good
    assert kept[1] == sorted(set(groups({d: shingles(source[d]["text"]) for d in good}, alike).values()))
    hit = {r["doc_id"] for r in QUERIES["op9_decontamination"](spark, SMALL).collect() if r["contaminated"]}
    assert kept[2] == [d for d in kept[1] if d not in hit]
    assert set(kept[3]) <= set(kept[2]) and max(Counter(kept[3]).values()) <= 3
    words = {d: len(WORD.findall(source[d]["text"])) for d in kept[2]}
    assert abs(sum(words[d] for d in kept[3]) - sum(words.values())) <= len({r["source"] for r in source.values()}) * max(words.values())
    assert kept[4] == kept[3]
    sizes = Counter(r["shard"] for r in step.collect())
    assert max(sizes.values()) - min([*sizes.values(), *([0] if len(sizes) < 40 else [])]) <= 1


def test_near_dedup_stage_against_exact_similarity(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = groups({r["doc_id"]: shingles(r["text"]) for r in docs.collect()}, alike)
    got = corpus_pipeline.near_dedup(spark, docs, SMALL)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == sorted(set(want.values()))


def test_items_without_id_hit(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "left of a passage without id and right"), (2, "other")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, "a passage without id"), ("k", "absent")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = connect(SF)
    for name in ("documents", "benchmark"):
        con.execute(f"create or replace view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    diff, _ = compare(spark, con, str(tmp_path), QUERIES["op9_decontamination"], ORACLES["op9_decontamination"])
    assert diff is None
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [r["doc_id"] for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()] == [2]
