"""Fill-in-the-middle: a text cut at two places between its units, its middle moved to the end behind marks."""

from __future__ import annotations

import re

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from shelf.llm import common

SEED = "42"
#: Percent of the texts that are moved at all, and of these that begin with the suffix.
RATE, SPM_RATE = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A word with the white space before it, or the white space at the end. Possessive: what a unit took is never given back.
UNITS = regex.compile(r"([\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)*+")

CUTS = pa.struct([("n", pa.int64()), ("first", pa.int64()), ("second", pa.int64())])


@F.arrow_udf(returnType=from_arrow_type(CUTS))
def _cuts(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    """The number of units and the code points before either cut: one match keeps the end of every repetition."""
    out = []
    for t, a, b in zip(text, h1.to_pylist(), h2.to_pylist()):
        ends = [0, *UNITS.fullmatch(t.as_py()).ends(1)]
        first, second = sorted((a % len(ends), b % len(ends)))
        out.append((len(ends) - 1, ends[first], ends[second]))
    n, first, second = zip(*out) if out else ((), (), ())
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (n, first, second)], fields=list(CUTS))


def draws(id: Column, seed: str = SEED, count: int = 4) -> list[Column]:
    """The first 8-digit groups of sha256("seed:id") as unsigned integers; a null id is an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(count)]


def transformed(
    docs: DataFrame, id: str = "doc_id", text: str = "text", into: str = "fim", seed: str = SEED, rate: int = RATE, spm_rate: int = SPM_RATE,
    prefix: str = PREFIX, suffix: str = SUFFIX, middle: str = MIDDLE,
) -> DataFrame:
    """``docs`` with a struct ``into`` (underscores added if taken): n units, form, prefix_chars, middle_chars, output.

    Form psm: ``prefix`` first-part ``suffix`` last-part ``middle`` middle-part; spm: the last part stands first; plain: the text as it is,
    where it is empty, holds a mark or isn't drawn. Either part may be empty. The draws depend on ``seed`` and ``id`` alone, so rows that
    repeat an id are cut at the same draws, and reruns agree. A null text is an empty one, a null id an empty string; an empty table gives
    an empty table. Texts are taken whole: a text needs one list of its units' ends in the task that reads it. Marks are of the form <...>, unlike
    each other, so that ``restored`` finds each one where it was put.
    """
    marks = (prefix, suffix, middle)
    if len(set(marks)) < 3 or not all(re.fullmatch(r"<[^<>]+>", m) for m in marks):
        raise ValueError("marks must differ and look like <...>")
    into = common.fresh(docs, into)
    t, c = F.coalesce(F.col(text), F.lit("")), common.fresh(docs, "_cuts")
    h = draws(F.col(id), seed)
    cuts = F.col(c)
    marked = F.contains(t, F.lit(prefix)) | F.contains(t, F.lit(suffix)) | F.contains(t, F.lit(middle))
    plain = (t == "") | marked | (h[2] % 100 >= rate)
    form = F.when(plain, "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")
    head, mid = t.substr(F.lit(1), cuts["first"].cast("int")), t.substr((cuts["first"] + 1).cast("int"), (cuts["second"] - cuts["first"]).cast("int"))
    tail = t.substr((cuts["second"] + 1).cast("int"), F.lit(2**31 - 1))
    p, s, m = (F.lit(x) for x in marks)
    output = F.when(form == "plain", t).when(form == "psm", F.concat(p, head, s, tail, m, mid)).otherwise(F.concat(s, tail, p, head, m, mid))
    moved = form != "plain"
    return docs.withColumn(c, _cuts(t, h[0], h[1])).withColumn(into, F.struct(
        cuts["n"].alias("n"), form.alias("form"), F.when(moved, cuts["first"]).alias("prefix_chars"),
        F.when(moved, cuts["second"] - cuts["first"]).alias("middle_chars"), output.alias("output"),
    )).drop(c)


def restored(output: Column, form: Column, prefix: str = PREFIX, suffix: str = SUFFIX, middle: str = MIDDLE) -> Column:
    """The text that an output was made of: cut at the first place of each mark in the order of its form; a plain one as it is."""
    def parts(one: str, two: str, three: str) -> tuple[Column, Column, Column]:
        a = F.lit(len(one) + 1)
        b = F.locate(two, output, 1)
        rest = output.substr(b + len(two), F.lit(2**31 - 1))
        c = F.locate(three, rest, 1)
        return output.substr(a, b - a), rest.substr(F.lit(1), c - 1), rest.substr(c + len(three), F.lit(2**31 - 1))

    head, tail, mid = parts(prefix, suffix, middle)
    tail_, head_, mid_ = parts(suffix, prefix, middle)
    return F.when(form == "psm", F.concat(head, mid, tail)).when(form == "spm", F.concat(head_, mid_, tail_)).otherwise(output)
