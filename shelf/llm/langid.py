"""Language identification by interpolated Kneser-Ney models of characters, one a language, kept in sorted arrays of hashes.

A text is read as its letters, lower-cased, with one space for whatever stands between them. Spark counts grams of ORDER characters by
language and derives the shorter ones, their continuation counts, discounts and back-off weights; what tasks are sent is bounded by ENTRIES.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from shelf.llm import common

ORDER = 5
#: Grams of all languages and lengths that a model keeps, the most frequent of each language and length; and the most frequent languages it knows.
ENTRIES, LANGUAGES = 250_000, 256
#: One training row in so many is kept from counting; up to so many of them, by the order of a hash, set the temperature and the limits of rejection.
CALIBRATION_SHARE, CALIBRATION_ROWS = 16, 1_000
#: Characters that are looked up together, distinct grams that a task gathers before it hands them on.
BATCH, HELD = 1 << 18, 1 << 20
UNKNOWN = "und"
#: What stands before a text's first character.
BEGIN = "\x01"
FACTOR = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def letters() -> np.ndarray:
    """Each code point as its lower-case letter, or as a space."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts as characters, each with ORDER - 1 marks of a beginning before it; where each begins; how many characters it has of its own."""
    given = [t or "" for t in texts]
    sizes = np.fromiter(map(len, given), np.int64, len(given))
    x = letters()[np.frombuffer("".join(given).encode("utf-32-le", "surrogatepass"), np.uint32)]
    at = np.concatenate([[0], np.cumsum(sizes)])
    gap = x == 32
    stay = ~gap
    stay[1:] |= gap[1:] & ~gap[:-1]  # the first space of a run
    begins = at[:-1][sizes > 0]
    stay[begins] = ~gap[begins]  # none at a text's beginning
    kept = np.concatenate([[0], np.cumsum(stay)])
    n = kept[at[1:]] - kept[at[:-1]]
    pad = ORDER - 1
    start = np.concatenate([[0], np.cumsum(n + pad)])
    out = np.full(int(start[-1]), ord(BEGIN), np.uint32)
    own = np.ones(len(out), bool)
    own[(start[:-1, None] + np.arange(pad)).reshape(-1)] = False
    out[own] = x[stay]
    return out, start, n


def hashes(x: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` characters that end at each place; every length has its own table of them."""
    h = np.zeros(len(places), np.uint64)
    for back in range(size - 1, -1, -1):
        h *= FACTOR
        h += x[places - back]
    h ^= h >> np.uint64(29)
    return h * FACTOR


def places(start: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Where the texts' own characters stand, BATCH of them at a time, and of which text each is."""
    own = np.concatenate([[0], np.cumsum(n)])
    for low in range(0, int(own[-1]), BATCH):
        nr = np.arange(low, min(low + BATCH, int(own[-1])))
        text = np.searchsorted(own, nr, side="right") - 1
        yield nr - own[text] + start[text] + ORDER - 1, text


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of one row of each key, and the number of its key for each row."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(keys) else np.zeros(0, bool)
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


GRAMS = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str | None]]]:
    """The batch's texts in parts of about BATCH characters, each whole, with the row a part begins at."""
    held, size, first = [], 0, 0
    for i, text in enumerate(batch.column(0)):
        held.append(text.as_py())
        size += len(held[-1] or "")
        if size >= BATCH:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of each language with their counts, gathered over a task in sorted arrays."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, spelt, n = (np.concatenate(x) for x in zip(*parts))
        one, number = _distinct(keys)
        return keys[one], spelt[one], np.bincount(number, n, len(one)).astype(np.int64)

    def flush(lang: str, part: tuple) -> Iterator[pa.RecordBatch]:
        _, spelt, n = part
        for i in range(0, len(n), 50_000):
            some = spelt[i : i + 50_000]
            text = np.ascontiguousarray(some).tobytes().decode("utf-32-le", "surrogatepass")
            grams = [text[j : j + ORDER] for j in range(0, len(text), ORDER)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(grams, pa.string()), pa.array(n[i : i + 50_000], pa.int64())], schema=GRAMS)

    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), object)
        for first, texts in _batches(batch):
            mine = langs[first : first + len(texts)]
            for lang in set(mine.tolist()):
                x, start, n = symbols([t for t, same in zip(texts, mine == lang) if same])
                parts = held.setdefault(lang, [])
                for at, _ in places(start, n):
                    keys = hashes(x, at, ORDER)
                    one, number = _distinct(keys)
                    parts.append((keys[one], x[at[one][:, None] + np.arange(1 - ORDER, 1)], np.bincount(number, minlength=len(one))))
                    if sum(len(p[0]) for p in parts) >= HELD:
                        parts[:] = [merged(parts)]
                        if len(parts[0][0]) >= HELD // 2:
                            yield from flush(lang, parts.pop())
            if sum(len(p[0]) for parts in held.values() for p in parts) >= 4 * HELD:
                for lang, parts in held.items():
                    if parts:
                        yield from flush(lang, merged(parts))
                held.clear()
    for lang, parts in held.items():
        if parts:
            yield from flush(lang, merged(parts))


def counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """Grams of ORDER characters of all the given texts: (lang, gram, n)."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    return rows.mapInArrow(_count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def estimated(grams: DataFrame, entries: int = ENTRIES, languages: int = LANGUAGES) -> DataFrame:
    """(lang, size, gram, share, back): of each kept gram its discounted share in its context, and the weight of the shorter model in that context.

    The longest grams count as often as they occur, a shorter one once for each gram that it ends (Kneser-Ney). A language's discount for a
    length is n1 / (n1 + 2 n2). What a context's kept grams leave of one is its weight, so the sum over characters stays one
    though rare grams go.
    """
    grams = common.saved(grams, "langid-grams")
    known = grams.groupBy("lang").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "lang").limit(languages)
    level = grams.join(F.broadcast(known.select("lang")), "lang")
    most = max(entries // max(1, known.count()) // ORDER, 1)
    out = None
    for size in range(ORDER, 0, -1):
        rate = level.groupBy("lang").agg(F.count(F.when(F.col("n") == 1, 1)).alias("n1"), F.count(F.when(F.col("n") == 2, 1)).alias("n2"))
        discount = rate.select("lang", F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5).alias("discount"))
        context = F.substring("gram", 1, size - 1)
        sums = level.groupBy("lang", context.alias("context")).agg(F.sum("n").alias("all"))
        top = level.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("k") <= most)
        # at most as many rows as languages, and as kept grams
        kept = top.join(F.broadcast(discount), "lang").withColumn("context", context).join(sums, ["lang", "context"])
        kept = kept.withColumn("share", (F.col("n") - F.col("discount")) / F.col("all"))
        back = kept.groupBy("lang", "context").agg((1 - F.sum("share")).alias("back"))
        part = kept.join(back, ["lang", "context"]).select("lang", F.lit(size).alias("size"), "gram", "share", "back")
        out = part if out is None else out.unionByName(part)
        if size > 1:
            level = common.saved(level.groupBy("lang", F.substring("gram", 2, size - 1).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "langid-grams")
    return out


@dataclass
class Model:
    """Of each language and length, sorted hashes of grams with log10 probabilities, and of contexts with log10 back-off weights."""

    langs: list[str] = field(default_factory=list)
    grams: list[list[tuple[np.ndarray, np.ndarray]]] = field(default_factory=list)
    contexts: list[list[tuple[np.ndarray, np.ndarray]]] = field(default_factory=list)
    floors: list[float] = field(default_factory=list)
    temperature: float = 1.0
    limits: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def logs(self, lang: int, ends: list[np.ndarray], before: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each gram: ``ends`` has its hashes by length from 1, ``before`` those of its contexts."""
        out = np.zeros(len(ends[0]))
        open_ = np.arange(len(out))
        for size in range(ORDER, 0, -1):
            found, value = _lookup(self.grams[lang][size - 1], ends[size - 1][open_])
            out[open_[found]] += value[found]
            open_ = open_[~found]
            if size > 1:
                found, value = _lookup(self.contexts[lang][size - 1], before[size - 1][open_])
                out[open_[found]] += value[found]
        out[open_] += self.floors[lang]
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy of each text in each language in bits a character (0 for a text without letters), and its number of characters."""
        x, start, n = symbols(texts)
        total = np.zeros((len(texts), len(self.langs)))
        for at, text in places(start, n):
            one, number = _distinct(hashes(x, at, ORDER))
            some = at[one]
            ends = [hashes(x, some, size) for size in range(1, ORDER + 1)]
            before = [hashes(x, some - 1, size - 1) for size in range(1, ORDER + 1)]
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(text, self.logs(k, ends, before)[number], len(texts))
        return -total / np.maximum(n, 1)[:, None] / math.log10(2), n


def _lookup(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    have, values = table
    if not len(have):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
    return have[at] == keys, values[at]


def _array(spelt: list[str], size: int) -> np.ndarray:
    x = np.frombuffer("".join(spelt).encode("utf-32-le", "surrogatepass"), np.uint32)
    return hashes(x, np.arange(size - 1, len(x), size), size)


def assembled(rows: dict[tuple[str, int], tuple[list[str], np.ndarray, np.ndarray]]) -> Model:
    """The model of estimated rows: by (lang, size) grams, shares and weights. Each probability adds the shorter model's by its weight."""
    langs = sorted({lang for lang, _ in rows})
    model = Model(langs)
    alphabet = {g for (_, size), (grams, _, _) in rows.items() if size == 1 for g in grams}
    even = -math.log10(len(alphabet) + 1)  # each known character's share, and that of all others
    for lang in langs:
        grams: list[tuple[np.ndarray, np.ndarray]] = []
        contexts: list[tuple[np.ndarray, np.ndarray]] = []
        model.grams.append(grams)
        model.contexts.append(contexts)
        for size in range(1, ORDER + 1):
            spelt, share, back = rows.get((lang, size), ([], np.zeros(0), np.zeros(0)))
            keys = _array(spelt, size)
            weight = np.log10(np.maximum(back, 1e-12))
            if size == 1:
                shorter = np.full(len(spelt), even)
                model.floors.append(even + (float(weight[0]) if len(weight) else 0.0))
                contexts.append((np.zeros(0, np.uint64), np.zeros(0)))
            else:
                shorter = _shorter(grams, contexts, spelt, size, model.floors[-1])
                heads = _array([g[:-1] for g in spelt], size - 1)
                one, _ = _distinct(heads)
                contexts.append((heads[one], weight[one]))
            order = np.argsort(keys)
            grams.append((keys[order], np.log10(share + 10 ** (weight + shorter))[order]))
    return model


def _shorter(grams: list, contexts: list, spelt: list[str], size: int, floor: float) -> np.ndarray:
    """log10 probability of the grams' last characters in the model of one character less."""
    out = np.zeros(len(spelt))
    open_ = np.arange(len(spelt))
    for m in range(size - 1, 0, -1):
        some = [spelt[i] for i in open_]
        found, value = _lookup(grams[m - 1], _array([g[-m:] for g in some], m))
        out[open_[found]] += value[found]
        some, open_ = [g for g, f in zip(some, found) if not f], open_[~found]
        if m > 1 and len(open_):
            found, value = _lookup(contexts[m - 1], _array([g[-m:-1] for g in some], m - 1))
            out[open_[found]] += value[found]
    out[open_] += floor
    return out


LANGUAGE = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()), ("rejected", pa.bool_())])


def confidence(bits: np.ndarray, n: np.ndarray, temperature: float) -> np.ndarray:
    """Share of each language where a text's characters count as their number's square root: neighbours tell much the same."""
    z = -bits * np.sqrt(np.maximum(n, 1))[:, None] / temperature
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _predict(shared):
    @F.arrow_udf(returnType=from_arrow_type(LANGUAGE))
    def predict(texts: pa.Array) -> pa.Array:
        model: Model = shared.value
        out: dict[str, list] = {f.name: [] for f in LANGUAGE}
        for _, some in _batches(pa.RecordBatch.from_arrays([texts], ["text"])):
            if model.langs:
                bits, n = model.entropies(some)
                best, share = bits.argmin(axis=1), confidence(bits, n, model.temperature)
            for i, t in enumerate(some):
                if not model.langs or not n[i]:
                    row = (UNKNOWN, 0.0, None, True)
                else:
                    k = int(best[i])
                    row = (model.langs[k], float(share[i, k]), float(bits[i, k]), bool(bits[i, k] > model.limits[k]))
                for c, v in zip(out, row):
                    out[c].append(v)
        return pa.StructArray.from_arrays([pa.array(out[f.name], f.type) for f in LANGUAGE], fields=list(LANGUAGE))

    return predict


def calibrated(model: Model, rows: list[tuple[str, str]]) -> Model:
    """Set the temperature of the score and, by language, the cross-entropy above which a text is rejected, from texts that weren't counted.

    The temperature has the least log loss of a list; a limit is the mean of the language's own texts plus four deviations, or those of
    all texts where a language has fewer than ten.
    """
    known = [(t, model.langs.index(l)) for t, l in rows if l in model.langs]
    found = [(np.zeros((0, len(model.langs))), np.zeros(0, np.int64))]
    for _, some in _batches(pa.RecordBatch.from_arrays([pa.array([t for t, _ in known], pa.string())], ["text"])):
        found.append(model.entropies(some))
    bits, n = (np.concatenate(x) for x in zip(*found))
    label = np.array([k for _, k in known], np.int64)[n > 0]
    bits, n = bits[n > 0], n[n > 0]
    own = bits[np.arange(len(label)), label]

    def limit(x: np.ndarray) -> float:
        return float(x.mean() + 4 * max(x.std(), 0.05))

    every = limit(own) if len(own) >= 10 else math.inf
    model.limits = np.array([limit(own[label == k]) if (label == k).sum() >= 10 else every for k in range(len(model.langs))])
    if len(own):
        tries = [2.0**i for i in range(-6, 7)]
        losses = [-np.log(np.maximum(confidence(bits, n, t)[np.arange(len(label)), label], 1e-12)).mean() for t in tries]
        model.temperature = tries[int(np.argmin(losses))]
    return model


def fitted(docs: DataFrame, text: str = "text", lang: str = "lang", entries: int = ENTRIES, languages: int = LANGUAGES) -> Model:
    """Learn from all rows of ``docs`` with text and language; those whose text hashes to one share in CALIBRATION_SHARE calibrate, the others count.

    Rows without a text, a letter or a language teach nothing. Repeated rows count as often as they stand there, but for calibration; texts
    are taken whole; an empty table gives a model without languages, of which every prediction is ``und``. The driver and the tasks hold
    ``entries`` grams at most, and CALIBRATION_ROWS texts for calibration, of which longer ones are left to the counts.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter("text is not null and lang is not null")
    key = F.md5(F.col("text"))
    aside = (F.conv(F.substring(key, 1, 4), 16, 10).cast("int") % CALIBRATION_SHARE == 0) & (F.char_length("text") <= BATCH)
    table = estimated(counts(rows.filter(~aside), "text", "lang"), entries, languages).toArrow()
    kinds = table.select(["lang", "size"]).group_by(["lang", "size"]).aggregate([]).to_pylist()
    parts = {}
    for k in kinds:
        some = table.filter(pc.and_(pc.equal(table["lang"], k["lang"]), pc.equal(table["size"], k["size"])))
        parts[(k["lang"], k["size"])] = (some["gram"].to_pylist(), some["share"].to_numpy(), some["back"].to_numpy())
    model = assembled(parts)
    some = rows.filter(aside).withColumn("key", key).orderBy("key", "lang").limit(CALIBRATION_ROWS)
    return calibrated(model, [(r["text"], r["lang"]) for r in some.toLocalIterator()])


def identified(docs: DataFrame, model: Model, text: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a struct ``into`` (underscores added if taken): lang_pred, score, cross_entropy, rejected.

    The language of least cross-entropy a character, the first by name of several; ``und`` with score 0 for a null text or one without a
    letter. ``score`` is its calibrated share, ``rejected`` is true where the cross-entropy is above the language's limit, so the text
    is likely in none of them. Texts are read whole, each for itself; rows that repeat get the same; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.withColumn(common.fresh(docs, into), _predict(shared)(F.col(text)))
