"""Hidden Markov language model: Baum-Welch counts summed over partitions train it, a scaled forward recursion scores texts exactly.

A state emits word classes; a class emits its words by their training counts, alike in all states. Words that make up one in
HEAD training tokens or more are classes of their own, so at most HEAD; the others share classes by a hash of their last letters.
Each text ends with one end token. What has no training count is one unknown event, whose share is that of words seen once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelf.llm import common

STATES = 6
ROUNDS = 4
HEAD = 20_000
TAIL = 4096
SUFFIX = 3
ADD = 0.1
#: Weight of the corpus's own class shares in each state's, in tokens.
PRIOR = 50.0
#: Words that share one dictionary, words that one numpy batch holds, tokens after which a text trains as another sequence.
CHUNK_WORDS = 2_000_000
BATCH = 400_000
SEGMENT = 100_000


def planes(x: np.ndarray) -> bytes:
    """The numbers' bytes by place, so that the high ones, mostly equal, compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplaned(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def _encode(id_type: pa.DataType):
    schema = pa.schema([("chunk", pa.int64()), ("id", id_type), ("held", pa.bool_()), ("ids", pa.binary()), ("pos", pa.int32()), ("word", pa.string()), ("n", pa.int64())])

    def flush(chunk: int, ids: list, held: list, texts: list[np.ndarray], seen: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
        """The texts as numbers of their dictionary, frequent words first, and the dictionary with its training counts."""
        none = len(texts)
        flat = np.concatenate(texts)
        train = np.concatenate([x for x, out in zip(texts, held) if not out] or [flat[:0]])
        n = np.bincount(train, minlength=len(seen))
        order = np.argsort(-np.bincount(flat, minlength=len(seen)), kind="stable")
        rank = np.empty(len(seen), np.int32)
        rank[order] = np.arange(len(seen), dtype=np.int32)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(none, chunk)), pa.array(ids, id_type), pa.array(held, pa.bool_()), pa.array([planes(rank[x]) for x in texts], pa.binary()),
            pa.nulls(none, pa.int32()), pa.nulls(none, pa.string()), pa.nulls(none, pa.int64()),
        ], schema=schema)
        spelt = list(seen)
        for i in range(0, len(order), 20_000):
            some = order[i : i + 20_000]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(some), chunk)), pa.nulls(len(some), id_type), pa.nulls(len(some), pa.bool_()), pa.nulls(len(some), pa.binary()),
                pa.array(np.arange(i, i + len(some), dtype=np.int32)), pa.array([spelt[j].decode() for j in some.tolist()]), pa.array(n[some]),
            ], schema=schema)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 24
        ids, held, texts, seen, size = [], [], [], {}, 0
        for batch in batches:
            for id, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = (text.as_py() or "").encode().lower().split()
                number = seen.setdefault
                texts.append(np.fromiter((number(w, len(seen)) for w in found), np.int32, len(found)))
                ids.append(id)
                held.append(out)
                size += len(found)
                if size >= CHUNK_WORDS:
                    yield from flush(chunk, ids, held, texts, seen)
                    chunk, ids, held, texts, seen, size = chunk + 1, [], [], [], {}, 0
        if texts:
            yield from flush(chunk, ids, held, texts, seen)

    return encode


class Classes:
    """Numbers of the classes, the log10 share of each, and of the words and the unknown event in the whole training corpus."""

    def __init__(self, tokens: int, ends: int, kinds: int, once: int, head: dict[str, int], sums: dict[int, tuple[int, int]]):
        self.tokens, self.ends, self.kinds, self.head = tokens, ends, kinds, head
        self.first_tail = len(head)
        self.end = self.first_tail + TAIL
        self.unknown = self.end + 1
        self.total = tokens + ADD * (kinds + 1)
        weight = np.zeros(self.unknown + 1)
        for k, (n, m) in sums.items():
            weight[k] = n + ADD * m
        weight[self.end] = ends + ADD * (ends > 0)
        self.weight = weight
        # a corpus in which no word occurs once still leaves room for one
        self.new = min(0.5, max(once, ADD) / max(tokens, 1)) if tokens else 1.0

    def shares(self) -> np.ndarray:
        """Share of each class in the training tokens, without the unknown one."""
        return self.weight[:-1] / max(self.weight.sum(), 1e-300)


def _code(classes: Classes, id_type: pa.DataType):
    schema = pa.schema([("id", id_type), ("held", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("inner", pa.float64()), ("codes", pa.binary())])

    def code(docs: pa.Table, words: pa.Table) -> pa.Table:
        """Texts of one chunk as classes, with what does not depend on the states: the base score and the words' shares in their classes."""
        pos = words.column("pos").to_numpy()
        n = np.zeros(len(pos), np.int64)
        n[pos] = words.column("c").to_numpy()
        kind = np.zeros(len(pos), np.int64)
        kind[pos] = classes.first_tail + words.column("tail").to_numpy()
        at, spelt = np.nonzero(words.column("head").is_valid().to_numpy())[0], words.column("head").drop_null().to_pylist()
        kind[pos[at]] = [classes.head[w] for w in spelt]
        kind[n == 0] = classes.unknown
        base = np.log10((n + ADD) / classes.total)
        weight = np.append(classes.weight[:-1], 1.0)[kind]
        inner = np.where(n > 0, np.log10((n + ADD) / np.maximum(weight, 1e-300)), 0.0)
        end = np.log10((classes.ends + ADD) / classes.total)
        out: dict[str, list] = {c: [] for c in schema.names}
        for id, held, ids in zip(docs.column("id").to_pylist(), docs.column("held").to_pylist(), docs.column("ids").to_pylist()):
            x = unplaned(ids, np.int32)
            row = (id, held, len(x) + 1, int((n[x] > 0).sum()) + (classes.ends > 0), float(base[x].sum() + end), float(inner[x].sum()), planes(kind[x].astype(np.uint16)))
            for c, v in zip(schema.names, row):
                out[c].append(v)
        return pa.Table.from_pydict(out, schema=schema)

    return code


class Model:
    """Start, move and emit probabilities; ``emit`` has a row for each class."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start.astype(np.float32), move.astype(np.float32), emit.astype(np.float32)


def begin(classes: Classes, states: int = STATES) -> Model:
    """States that stay, each with the corpus's class shares up to four times more or less, by a hash of class and state."""
    noise = np.array([[zlib.crc32(f"{k}:{z}".encode()) / 2**31 - 1 for z in range(states)] for k in range(classes.unknown)])
    move = np.full((states, states), 0.02 / states) + 0.98 * np.eye(states)
    return estimated(classes, np.ones(states), 1e6 * move, 1e6 * classes.shares()[:, None] * 4**noise)


def estimated(classes: Classes, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
    """Probabilities from expected counts; the unknown event takes its share of every state."""
    emit = emit + PRIOR * classes.shares()[:, None]
    emit = (1 - classes.new) * emit / np.maximum(emit.sum(axis=0), 1e-300)
    start, move = start + 1.0, move + 1.0
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), np.vstack([np.maximum(emit, 1e-30), np.full(emit.shape[1], classes.new)]))


def padded(sequences: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Sequences in batches of like length, longest first: their numbers, lengths, and classes by step and sequence."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    i = 0
    while i < len(order):
        longest = len(sequences[order[i]])
        some = order[i : i + max(1, BATCH // max(longest, 1))]
        i += len(some)
        grid = np.zeros((longest, len(some)), np.int32)
        for j, k in enumerate(some):
            grid[: len(sequences[k]), j] = sequences[k]
        yield some, np.array([len(sequences[k]) for k in some]), grid


def forward(model: Model, lengths: np.ndarray, grid: np.ndarray, keep: bool = False):
    """log10 likelihood of each sequence; with ``keep`` also the scaled forward values and the scales, by step."""
    steps, width = grid.shape
    live = np.searchsorted(-lengths, -np.arange(steps), side="left")  # sequences longer than the step come first
    scales = np.ones((steps, width), np.float32)
    values = np.zeros((steps, width, len(model.start)), np.float32) if keep else None
    a = np.broadcast_to(model.start, (width, len(model.start)))
    for t in range(steps):
        n = live[t]
        a = (a[:n] @ model.move if t else a[:n]) * model.emit[grid[t, :n]]
        c = a.sum(axis=1)
        a = a / c[:, None]
        scales[t, :n] = c
        if keep:
            values[t, :n] = a
    return np.log10(scales, dtype=np.float64).sum(axis=0), values, scales, live


def expected(model: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions of the sequences under the model, and their log10 likelihood."""
    states = len(model.start)
    starts, moves, emits, total = np.zeros(states), np.zeros((states, states)), np.zeros((len(model.emit), states)), 0.0
    for _, lengths, grid in padded(sequences):
        score, values, scales, live = forward(model, lengths, grid, keep=True)
        total += score.sum()
        b = np.ones((grid.shape[1], states), np.float32)
        for t in range(len(grid) - 1, -1, -1):
            n = live[t]
            if t + 1 < len(grid) and (m := live[t + 1]):
                ahead = model.emit[grid[t + 1, :m]] * b[:m] / scales[t + 1, :m, None]
                moves += values[t, :m].T @ ahead
                b[:m] = ahead @ model.move.T
            values[t, :n] *= b[:n]  # from here on the step's posterior; the step before needs only its own forward values
        starts += values[0].sum(axis=0)
        here = np.arange(len(grid))[:, None] < lengths[None, :]
        kinds, weights = grid[here], values[here]
        for z in range(states):
            emits[:, z] += np.bincount(kinds, weights=weights[:, z], minlength=len(model.emit))
    return starts, moves * model.move, emits, total


def _sequences(batch: pa.RecordBatch, end: int, segment: int | None) -> list[np.ndarray]:
    out = []
    for data in batch.column(0).to_pylist():
        x = np.append(unplaned(data, np.uint16).astype(np.int32), np.int32(end))
        out.extend(np.split(x, range(segment, len(x), segment)) if segment and len(x) > segment else [x])
    return out


def _count(model: Model, end: int):
    states = len(model.start)
    schema = pa.schema([("kind", pa.int32()), ("row", pa.int32()), *((f"s{z}", pa.float64()) for z in range(states))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, total = None, 0.0
        for batch in batches:
            sequences = _sequences(batch, end, SEGMENT)
            if sequences:
                *found, score = expected(model, sequences)
                sums = found if sums is None else [x + y for x, y in zip(sums, found)]
                total += score
        if sums is not None:
            starts, moves, emits = sums
            rows = np.vstack([starts[None, :], moves, np.full((1, states), total), emits])
            kinds = np.repeat(np.array([0, 1, 2, 3], np.int32), [1, states, 1, len(emits)])
            number = np.concatenate([[0], np.arange(states), [0], np.arange(len(emits))]).astype(np.int32)
            some = (rows != 0).any(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(kinds[some]), pa.array(number[some]), *(pa.array(rows[some, z]) for z in range(states))], schema=schema)

    return count


def _score(model: Model, end: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequences = _sequences(batch, end, None)
            out = np.zeros(len(sequences))
            for numbers, lengths, grid in padded(sequences):
                out[numbers] = forward(model, lengths, grid)[0]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out)], names=[*batch.schema.names[1:], "log"])

    return score


def fitted(docs: DataFrame, id: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS) -> tuple[DataFrame, Classes, Model]:
    """The texts as classes (id, held, n_tokens, n_known, base_score, inner, codes), the classes, and the model trained on those not held.

    Texts are numbered within chunks, each with a dictionary of its own; the dictionaries meet by word (one row a chunk, so a
    frequent word is no hot key of tokens), which gives each its corpus counts, and go back to their chunks. Baum-Welch rounds read
    the coded texts; each partition sums its expected counts, the sums meet by class, and at most HEAD + TAIL + 2 rows come to the driver.
    """
    spark = docs.sparkSession
    spec = docs.select(F.col(id).alias("id")).schema["id"].dataType
    id_type = pa.int64() if spec.typeName() == "long" else pa.int32() if spec.typeName() == "integer" else pa.string()
    spelt = {"int64": "long", "int32": "int"}.get(str(id_type), "string")
    held = F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")) % 10 == 0
    source = docs.select(F.col(id).cast(spelt).alias("id"), held.alias("held"), F.col(text).alias("text"))
    coded = source.mapInArrow(_encode(id_type), f"chunk long, id {spelt}, held boolean, ids binary, pos int, word string, n long")
    coded = common.saved(coded, "hmm-coded")
    texts = coded.filter("ids is not null")
    words = coded.filter("word is not null").select("chunk", "pos", "word", "n")
    ends = texts.filter("not held").count()
    tokens = (words.agg(F.sum("n").alias("n")).first()["n"] or 0) + ends

    by_word = Window.partitionBy("word")
    c = F.sum("n").over(by_word)
    lexicon = words.withColumn("c", c).withColumn("first", (F.min("chunk").over(by_word) == F.col("chunk")) & (F.col("c") > 0))
    lexicon = lexicon.select(
        "chunk", "pos", "c", "first", F.pmod(F.crc32(F.substring("word", -SUFFIX, SUFFIX).cast("binary")), F.lit(TAIL)).cast("int").alias("tail"),
        F.when((F.col("c") > 0) & (F.col("c") * HEAD >= tokens), F.col("word")).alias("head"),
    )
    lexicon = common.saved(lexicon, "hmm-lexicon")
    known = lexicon.filter("first")
    about = known.agg(F.count(F.lit(1)).alias("kinds"), F.count(F.when(F.col("c") == 1, 1)).alias("once")).first()
    heads = known.filter("head is not null").select("head", "c").orderBy(F.desc("c"), "head").collect()
    head = {r["head"]: i for i, r in enumerate(heads)}
    sums = {i: (r["c"], 1) for i, r in enumerate(heads)}
    for r in known.filter("head is null").groupBy("tail").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("m")).collect():
        sums[len(head) + r["tail"]] = (r["n"], r["m"])
    classes = Classes(tokens, ends, about["kinds"] + (ends > 0), about["once"], head, sums)

    both = texts.select("chunk", "id", "held", "ids").groupBy("chunk").cogroup(lexicon.select("chunk", "pos", "c", "tail", "head").groupBy("chunk"))
    out = both.applyInArrow(_code(classes, id_type), f"id {spelt}, held boolean, n_tokens long, n_known long, base_score double, inner double, codes binary")
    out = common.saved(out, "hmm-texts")
    model = begin(classes, states)
    for _ in range(rounds):
        names = [f"s{z}" for z in range(states)]
        parts = out.filter("not held").select("codes").mapInArrow(_count(model, classes.end), "kind int, row int, " + ", ".join(f"{s} double" for s in names))
        found = parts.groupBy("kind", "row").agg(*[F.sum(s).alias(s) for s in names]).collect()
        if not found:
            break
        starts, moves, emits = np.zeros(states), np.zeros((states, states)), np.zeros((classes.unknown, states))
        for r in found:
            value = [r[s] for s in names]
            if r["kind"] == 0:
                starts[:] = value
            elif r["kind"] == 1:
                moves[r["row"]] = value
            elif r["kind"] == 3 and r["row"] < classes.unknown:
                emits[r["row"]] = value
        model = estimated(classes, starts, moves, emits)
    return out, classes, model


def scored(docs: DataFrame, id: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Held out are the rows whose crc32 of the id as text (null: empty) leaves no rest by 10. A null or empty text is its end token
    alone; repeated rows each count and score; texts of any length are scored whole; an empty table gives no rows. Where no row
    trains, all is unknown: the base is that of no counts, and every state gives the unknown event all its share.
    """
    texts, classes, model = fitted(docs, id, text, states, rounds)
    spelt = dict(texts.dtypes)["id"]
    out = texts.select("codes", "id", "held", "n_tokens", "n_known", "base_score", "inner").mapInArrow(
        _score(model, classes.end), f"id {spelt}, held boolean, n_tokens long, n_known long, base_score double, inner double, log double"
    )
    # within its class the end token is all there is, so its share adds nothing
    return out.select(
        "id", F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(classes.tokens).cast("long").alias("train_tokens"), "base_score",
        (F.col("log") + F.col("inner")).alias("score"),
    )
