"""Fill-in-the-middle, conversation repair and language identification: cases, brute force, round trips and held-out accuracy."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelf.llm import dialogue, fim, langid
from shelf.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
LONG = " ".join(f"w{i}" for i in range(60_000))


# --- fill-in-the-middle

DOCS = "doc_id long, text string, fim string, _cuts int"


def test_fim_round_trip_and_cuts(spark):
    texts = [None, "", " ", "  \n\t ", "one", " one ", "a b\tc\n\nd  ", "has <P> in it", "ends <", "<S", "S> <M", "é\U0001f600  x ñ y z", LONG, "<P<S<M a b c", *[f"t{i} u v  w" for i in range(60)]]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "no id here", "c", 1), (20, texts[20], "again", 1)], DOCS)
    out = fim.transformed(docs, rate=100, spm_rate=50)
    assert out.columns == [*docs.columns, "fim_"]
    rows = out.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "fim_.*", fim.restored(F.col("fim_.output"), F.col("fim_.form")).alias("back")).collect()
    assert len(rows) == len(texts) + 2 and {r["form"] for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", r["text"])
        assert r["back"] == r["text"] and r["n"] == len(units) and "".join(units) == r["text"]
        digest = hashlib.sha256(f"42:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()
        a, b = sorted(int(digest[i : i + 8], 16) % (len(units) + 1) for i in (0, 8))
        head, mid, tail = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        if r["form"] == "plain":
            assert r["text"] == "" or any(m in r["text"] for m in ("<P>", "<S>", "<M>"))
            assert (r["prefix_chars"], r["middle_chars"], r["output"]) == (None, None, r["text"])
        else:
            assert (r["prefix_chars"], r["middle_chars"]) == (len(head), len(mid))
            assert r["output"] == (f"<P>{head}<S>{tail}<M>{mid}" if r["form"] == "psm" else f"<S>{tail}<P>{head}<M>{mid}")


def test_fim_empty_table_and_marks(spark):
    assert fim.transformed(spark.createDataFrame([], DOCS)).count() == 0
    one = spark.createDataFrame([(1, "a b", None, None)], DOCS)
    assert {r["fim_"]["form"] for r in fim.transformed(one, rate=0).collect()} == {"plain"}
    for marks in ({"prefix": "<S>"}, {"middle": "M"}):
        with pytest.raises(ValueError):
            fim.transformed(one, **marks)


# --- conversation repair

def brute(turns):
    """Cheapest (cost, script, lines) of (role, text) turns by trying every edit; of equal costs the least script."""
    faults, seen = [], set()
    for role, text in turns:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))

    @cache
    def best(i, state, inserted):
        """state: last initial emitted; at most two insertions in a row are ever of use."""
        found = []
        if i == len(turns) and state in ("", "a"):
            found.append((0, "", ()))
        due = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[due]

        def add(cost, letter, line, rest):
            found.append((cost + rest[0], letter + rest[1], (*([] if line is None else [line]), *rest[2])))

        if inserted < 2:
            add(2, "I", f"{name}:", best(i, due, inserted + 1))
        if i < len(turns):
            role, text = turns[i]
            late = faults[i] == "truncated"
            add(3, "D", None, best(i + 1, state, 0))
            if faults[i] not in ("blank", "duplicate"):
                if role[:1] == due or role[:1] == "s" and state == "":
                    add(late, "K", f"{role}:{text}", best(i + 1, role[:1], 0))
                add(2 + late, "R", f"{name}:{text}", best(i + 1, due, 0))
        return min(found, default=(10**6, "~", ()))

    cost, script, lines = best(0, "", 0)
    initials = "".join(r[:1] or "-" for r, _ in turns)
    return {
        "cost": cost, "audit": script, "sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(), "illegal": sum(p not in ("su", "ua", "au") for p in map("".join, itertools.pairwise(initials))),
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
    }


def test_least_scripts_against_brute_force():
    rng = random.Random(5)
    convs = [[rng.randrange(16) for _ in range(rng.randrange(9))] for _ in range(600)] + [list(x) for x in itertools.product((0, 4, 8, 5, 12), repeat=3)]
    body = {0: "{}.", 1: "{}", 2: " ", 3: "{}."}
    for code, (cost, edits, _, _) in zip(convs, dialogue.least_scripts([np.array(c, np.int64) for c in convs])):
        # turns of different texts, so a duplicate is made one by the code alone: it is written as blank, which costs the same
        turns = [(("system", "user", "assistant", "tool")[c // 4], " " if c % 4 == 3 else body[c % 4].format(i)) for i, c in enumerate(code)]
        want = brute(turns)
        assert (cost, "".join(dialogue.LETTERS[e] for e in edits)) == (want["cost"], want["audit"]), code


def sound(row):
    return (row["role"] if row["role"] is not None else " ", row["text"] if row["text"] is not None else " ")


def replay(rows):
    """By conversation: what the query must return, from plain rows."""
    convs = {}
    for r in rows:
        convs.setdefault(r["conv_id"], [])
        key = ":".join(" " if x is None else str(x) for x in (r["conv_id"], r["turn"]))
        n = zlib.crc32(key.encode()) % 20
        role, text = sound(r)
        if n:
            one = (r["turn"], "user" if n == 4 else role, "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text)
            convs[r["conv_id"]] += [one] * (2 if n == 3 else 1)
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, hashlib.md5(f"{len(t[1].encode())}:{t[1]}{t[2]}".encode()).digest()))
        known = {t[0] for t in turns} - {None}
        out[conv] = {**brute([t[1:] for t in turns]), "gaps": max(known) - min(known) + 1 - len(known) if known else 0}
    return out


def check(got, want):
    assert {r["conv_id"] for r in got} == set(want) and len(got) == len(want)
    for r in got:
        w = want[r["conv_id"]]
        assert {c: r[c] for c in w if c != "sha256"} | {"sha256": r["repaired_sha256"]} == w, r


def test_dialogue_query_against_brute_force(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    check(QUERIES["op12_dialogue_repair"](spark, SF).collect(), replay(rows))


def test_dialogue_cases(spark, tmp_path):
    rng = random.Random(9)
    roles = ["user", "assistant", "system", "tool", "", None, "User", "unknown"]
    texts = ["Yes.", "No", "", None, " \n", "Why? ", "So!", "same.", "very long " * 3000 + ".", " "]
    rows = [(c, rng.choice([None, 1, 2, 3, 4, 9]), rng.choice(roles), rng.choice(texts), "x", 1, "y") for c in range(40) for _ in range(rng.randrange(1, 9))]
    rows += [(None, t, r, x, "x", 1, "y") for t, r, x in [(1, "user", "a."), (2, "assistant", "b."), (None, None, None)]] + [(77, 5, "user", "a.", "x", 1, "y")] * 3
    schema = "conv_id long, turn long, role string, text string, h string, block int, c string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/conversations.parquet")
    named = [dict(zip(("conv_id", "turn", "role", "text"), r)) for r in rows]
    check(QUERIES["op12_dialogue_repair"](spark, str(tmp_path)).collect(), replay(named))
    reports, turns = dialogue.repaired(spark.createDataFrame([], schema))
    assert reports.count() == 0 and turns.count() == 0


def test_long_conversation_is_dealt_in_blocks(spark):
    """A conversation of several blocks and tasks, whose repeats lie in other blocks than what they repeat."""
    n = 3 << dialogue.BLOCK_BITS
    i = F.col("id")
    rows = spark.range(n).select(
        F.lit(1).alias("conv_id"), i.alias("turn"), F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("t"), F.when(i == n - 2, F.lit(4)).otherwise(i).cast("string"), F.lit(".")).alias("text"),
    )
    reports, turns = dialogue.repaired(rows)
    got = reports.collect()
    assert [(r["duplicate"], r["gaps"], r["illegal"]) for r in got] == [(1, 0, 0)]
    # the repeated question goes, and its answer with it or a question is put in before it: an insertion is cheaper
    assert got[0]["cost"] == 5 and got[0]["audit"] == "K" * (n - 2) + "DIK"
    ordered = turns.orderBy("place").collect()
    assert [r["place"] for r in ordered] == list(range(n)) and [r["text"] for r in ordered[-3:]] == [f"t{n - 3}.", "", f"t{n - 1}."]


# --- language identification

def test_symbols_keep_letters_and_single_spaces():
    x, start, n = langid.symbols(["  Ab,1 c!", None, "", "12", "É"])
    assert n.tolist() == [5, 0, 0, 0, 1]
    shown = "".join(map(chr, x))
    assert [shown[a:b].strip(langid.BEGIN) for a, b in zip(start, start[1:])] == ["ab c ", "", "", "", "é"]


def test_models_sum_to_one(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([("".join(rng.choice("abcde  ") for _ in range(400)), lang) for lang in "xy" for _ in range(12)], "text string, lang string")
    model = langid.fitted(docs)
    few = langid.fitted(docs, entries=200)  # pruned models still share out one
    for m in (model, few):
        for lang in range(2):
            for head in ("abca", "a b ", "zzzz", "\x01\x01\x01\x01", "\x01\x01ab"):
                some = [head + c for c in "abcde z"]
                x = np.array([ord(c) for g in some for c in g], np.uint32)
                at = np.arange(4, len(x), 5)
                ends = [langid.hashes(x, at, k) for k in range(1, 6)]
                before = [langid.hashes(x, at - 1, k - 1) for k in range(1, 6)]
                p = 10 ** m.logs(lang, ends, before)
                assert p.sum() == pytest.approx(1, abs=1e-6)  # z stands for all that was never seen


def test_kneser_ney_of_a_small_text_by_hand(spark):
    """The model of two characters' length and less, from grams counted by hand."""
    text = "abab ac"
    rows = {(r["size"], r["gram"]): r for r in langid.estimated(langid.counts(spark.createDataFrame([(text, "l")], "text string, lang string"), "text", "lang")).collect()}
    padded = langid.BEGIN * 4 + text
    tops = {padded[i - 4 : i + 1] for i in range(4, len(padded))}
    for size in range(1, 5):
        kinds = {g[-size - 1 :] for g in tops}
        want = {}
        for g in kinds:
            want[g[1:]] = want.get(g[1:], 0) + 1
        mine = {g: r for (k, g), r in rows.items() if k == size}
        assert mine.keys() == want.keys()
        ones, twos = (sum(v == k for v in want.values()) for k in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        for g, n in want.items():
            total = sum(v for o, v in want.items() if o[:-1] == g[:-1])
            assert mine[g]["share"] == pytest.approx((n - d) / total)
            assert mine[g]["back"] == pytest.approx(d * sum(o[:-1] == g[:-1] for o in want) / total)


def test_language_cases(spark):
    schema = "doc_id long, text string, lang string, language string"
    en, de = "the house and the garden of the king ", "das haus und der garten des königs "
    rows = [(i, (en if i % 2 else de) * (1 + i % 3) + str(i), "en" if i % 2 else "de", "z") for i in range(400)]
    rows += [(900, None, "en", None), (901, "some words", None, None), (902, "123 !!", "en", None), (None, en, "en", None), (903, LONG, "en", None), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, schema)
    model = langid.fitted(docs)
    assert model.langs == ["de", "en"]
    got = {r["doc_id"]: r["language_"] for r in langid.identified(docs, model).collect()}
    assert got[900]["lang_pred"] == got[902]["lang_pred"] == "und" and got[900]["score"] == 0 and got[901]["lang_pred"] in model.langs
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "de") and 0.5 < got[i]["score"] <= 1 and not got[i]["rejected"] for i in range(400))
    empty = spark.createDataFrame([], schema)
    assert langid.identified(empty, model).count() == 0
    none = langid.fitted(empty)
    assert {r["language_"]["lang_pred"] for r in langid.identified(docs, none).collect()} == {"und"}
    alien = spark.createDataFrame([(1, "qwxz jkvq zzxw qqjx " * 20, "en", None)], schema)
    assert langid.identified(alien, model).first()["language_"]["rejected"]


def test_a_long_text_is_scored_like_its_parts_together():
    """Places are looked up a batch at a time; where the batches are cut changes nothing."""
    model = langid.Model(["l"], [[(np.zeros(0, np.uint64), np.zeros(0))] * 5], [[(np.zeros(0, np.uint64), np.zeros(0))] * 5], [-1.0])
    bits, n = model.entropies(["ab" * langid.BATCH, "x", None])
    assert n.tolist() == [2 * langid.BATCH, 1, 0] and bits[:, 0].tolist() == pytest.approx([1 / np.log10(2)] * 2 + [0])


def test_language_held_out_accuracy(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()}
    got = QUERIES["op13_language_id"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        text = docs[r["doc_id"]]["text"]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (text is None or not any(c.isalpha() for c in text))
    out = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in out) >= 0.98 * len(out)
