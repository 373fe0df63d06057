"""Benchmark decontamination: one Aho-Corasick automaton over the words of test items scans each text once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelf.llm import common

WINDOW = 10
#: Words of test items in one automaton; a larger test set is scanned in as many turns as it has such blocks.
BLOCK_WORDS = 2_000_000
WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bytes of words as they are, A-Z in lower case, all others a blank; one byte stays one byte, so offsets hold.
FOLD = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))

HITS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])
HITS_ARROW = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
])


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


class Automaton:
    """All windows of the items, as sequences of word numbers."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        held: dict[tuple[int, ...], list[int]] = {}
        self.names = [name for name, _ in items]
        for k, (_, text) in enumerate(items):
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text)]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1) if ids else ():
                held.setdefault(tuple(ids[i : i + size]), []).append(k)
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, owners in held.items():
            self.trie.add_word(key, (len(key), tuple(set(owners))))
        self.empty = not held
        if held:
            self.trie.make_automaton()

    def scan(self, text: str | None) -> dict:
        """Counts, the items that occur, and the hit stretches as code point offsets of the text as given."""
        found = words(text)
        out = {"n_words": len(found), "n_hit": 0, "items": [], "spans": []}
        if self.empty or not found:
            return out
        get = self.numbers.get
        runs: list[list[int]] = []
        owners: set[int] = set()
        for end, (size, of) in self.trie.iter(tuple([get(w, 0) for w in found])):
            owners.update(of)
            first = end - size + 1
            while runs and first <= runs[-1][1]:  # windows come by their ends; a shorter one may begin later than the one before
                first = min(first, runs.pop()[0])
            runs.append([first, end + 1])
        if runs:
            whole = text.encode()
            at = [m.span() for m in WORD_BYTES.finditer(whole.translate(FOLD))]
            done = chars = 0
            for first, last in runs:
                ends = []
                for to in (at[first][0], at[last - 1][1]):
                    chars += len(whole[done:to].decode())
                    done = to
                    ends.append(chars)
                out["spans"].append({"start": ends[0], "end": ends[1]})
            out["n_hit"] = sum(last - first for first, last in runs)
            out["items"] = sorted({self.names[k] for k in owners} - {None})
        return out


def _scan(items: list[tuple[str | None, str]], window: int):
    @F.arrow_udf(returnType=HITS)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = Automaton(items, window)
        for batch in batches:
            yield pa.array([automaton.scan(t) for t in batch.to_pylist()], type=HITS_ARROW)

    return scan


def blocks(
    items: DataFrame, id: str = "item_id", text: str = "text", block_words: int = BLOCK_WORDS, nameless: bool = False,
) -> Iterator[list[tuple[str | None, str]]]:
    """The items in blocks of at most ``block_words`` words (or one longer item), one block in memory at a time."""
    held: list[tuple[str | None, str]] = []
    size = 0
    for r in items.filter(F.col(text).isNotNull() & (F.col(id).isNotNull() | F.lit(nameless))).select(F.col(id).cast("string").alias("i"), F.col(text).alias("t")).toLocalIterator():
        n = len(words(r["t"]))
        if held and size + n > block_words:
            yield held
            held, size = [], 0
        held.append((r["i"], r["t"]))
        size += n
    yield held



def contaminated(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
    block_words: int = BLOCK_WORDS, into: str = "hits", nameless: bool = False,
) -> DataFrame:
    """``docs`` with a struct ``into`` (underscores added if taken): n_words, n_hit, items (ids as sorted strings), spans.

    A window is ``window`` consecutive words of an item, or all words of a shorter one. Null and empty texts and items have no
    words and hit nothing; items that repeat count once by id; an item without id is left out or, if ``nameless``, hits and has
    spans like any other but is not among the items; no items: nothing is hit.
    Should the items outgrow one automaton, each block of them scans the texts in turn, and the spans are united after it.
    """
    into = common.fresh(docs, into)
    out = None
    for block in blocks(items, item_id, item_text, block_words, nameless):
        part = _scan(block, window)(F.col(text))
        if out is None:
            out = docs.withColumn(into, part)
        else:
            more = common.fresh(out, "_more")
            out = common.saved(out, "decontam").withColumn(more, part)
            out = out.withColumn(into, _unite(F.col(into), F.col(more), F.col(text))).drop(more)
    return out


@F.arrow_udf(returnType=HITS)
def _unite(a: pa.Array, b: pa.Array, text: pa.Array) -> pa.Array:
    """The hits of two blocks of items over the same texts."""
    out = []
    for x, y, t in zip(a.to_pylist(), b.to_pylist(), text.to_pylist()):
        spans: list[dict] = []
        for s in sorted(x["spans"] + y["spans"], key=lambda s: (s["start"], s["end"])):
            if spans and s["start"] <= spans[-1]["end"]:
                spans[-1]["end"] = max(spans[-1]["end"], s["end"])
            else:
                spans.append(dict(s))
        hit = sum(len(words(t[s["start"] : s["end"]])) for s in spans)
        out.append({"n_words": x["n_words"], "n_hit": hit, "items": sorted({*x["items"], *y["items"]}), "spans": spans})
    return pa.array(out, type=HITS_ARROW)


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no test item's window occurs, columns unchanged."""
    hits = common.fresh(docs, "hits")
    return contaminated(docs, items, into=hits, **options).filter(F.col(hits)["n_hit"] == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
