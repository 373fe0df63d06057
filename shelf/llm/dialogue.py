"""Conversation repair: the cheapest edits that make a conversation an optional system turn and whole user/assistant pairs.

An edit script has one letter an edit: Keep, Rerole or Delete each turn, Insert one. What has been emitted is one of four states: nothing,
a system turn, a user turn still to be answered, an assistant's answer. From a state, no two edits of one letter go on differently, so a
script's letters tell its path. A backward pass finds the least cost from every (turn, state); the arcs on cheapest paths become
nodes, ranked by their scripts' first 1, 2, 4, ... letters through pointers that double each round, and the ranks choose the least script.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from shelf.llm import common

LETTERS = "DIKR"
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
OTHER = 3
#: State after a turn of the role that may come next: a user's after all but a user's.
NEXT = np.array([USER, USER, ASSISTANT, USER])
#: State after keeping a turn of class system, user, assistant, other in each state; -1 where it can't be kept.
KEPT = np.array([[SYSTEM, USER, -1, -1], [-1, USER, -1, -1], [-1, -1, ASSISTANT, -1], [-1, USER, -1, -1]])
FAULTS = SOUND, TRUNCATED, BLANK, DUPLICATE = range(4)
FAR = 1 << 29
#: Turns of one block: what a task gathers of a conversation at once besides its letters.
BLOCK_BITS = 13
#: Turns that are solved together.
BATCH = 30_000
ROLES = {USER: "user", ASSISTANT: "assistant"}


def least_scripts(convs: list[np.ndarray]) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each conversation, an array of 4 * class + fault: cost, letters, and of each letter the turn it stands at and the state before it."""
    sizes = np.array([len(x) for x in convs], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    layers = int(sizes.sum()) + len(convs)
    last = first + sizes
    kind, late, must, ends = np.full(layers, OTHER), np.zeros(layers, np.int64), np.zeros(layers, bool), np.zeros(layers, bool)
    ends[last] = True
    flat = np.concatenate(convs) if convs else np.zeros(0, np.int64)
    kind[~ends], late[~ends], must[~ends] = flat // 4, CUT_OFF * (flat % 4 == TRUNCATED), flat % 4 >= BLANK
    kept = KEPT[:, kind].T
    may = (kept >= 0) & ~must[:, None] & ~ends[:, None]

    cost = np.full((layers, 4), FAR)
    by_size = np.argsort(-sizes, kind="stable")
    for step in range(int(sizes.max(initial=0)) + 1):
        at = last[by_size[: np.searchsorted(-sizes[by_size], -step, side="right")]] - step
        if step == 0:
            base = np.tile(np.array([0, FAR, FAR, 0]), (len(at), 1))
        else:
            after, extra = cost[at + 1], late[at][:, None]
            base = after + DELETE
            base = np.minimum(base, np.where(may[at], np.take_along_axis(after, np.maximum(kept[at], 0), 1) + extra, FAR))
            base = np.minimum(base, np.where(must[at][:, None], FAR, after[:, NEXT] + REROLE + extra))
        # inserting twice comes back to the same state, so one insertion from each state is enough
        answered, asked = np.minimum(base[:, ASSISTANT], base[:, USER] + INSERT), np.minimum(base[:, USER], base[:, ASSISTANT] + INSERT)
        cost[at] = np.stack([np.minimum(base[:, START], asked + INSERT), np.minimum(base[:, SYSTEM], asked + INSERT), asked, answered], 1)

    here = np.arange(layers)[:, None]
    after = np.vstack([cost[1:], np.full((1, 4), FAR)])
    extra, open_ = late[:, None], ~ends[:, None]
    to_state = np.stack([np.tile(np.arange(4), (layers, 1)), np.tile(NEXT, (layers, 1)), np.maximum(kept, 0), np.tile(NEXT, (layers, 1))], 2)
    on = np.stack([
        open_ & (after + DELETE == cost), cost[:, NEXT] + INSERT == cost, may & (np.take_along_axis(after, np.maximum(kept, 0), 1) + extra == cost),
        open_ & ~must[:, None] & (after[:, NEXT] + REROLE + extra == cost),
    ], 2)
    to_layer = here + np.array([1, 0, 1, 1])
    arcs = np.flatnonzero(on)
    end = len(arcs)
    # nodes in the order of (turn, state, letter): a state's first arc is that with the least letter, which is its rank by one letter
    starts = np.searchsorted(arcs, 4 * np.arange(4 * layers + 1))
    target = (4 * np.broadcast_to(to_layer[:, None, :], on.shape) + to_state).reshape(-1)[arcs]
    pointer = np.append(np.where(starts[target] < starts[target + 1], starts[target], end), end)
    rank = np.append(arcs % 4 + 1, 0)
    pointers = [pointer]
    while (pointer < end).any():
        rank = np.unique(rank * (end + 1) + rank[pointer], return_inverse=True)[1]  # the end alone has rank 0 and keeps it
        pointer = pointer[pointer]
        pointers.append(pointer)

    some = np.flatnonzero(starts[4 * first] < starts[4 * first + 1])
    choices = np.concatenate([np.arange(starts[4 * f], starts[4 * f + 1]) for f in first[some]] or [np.zeros(0, np.int64)])
    owner = np.repeat(some, starts[4 * first[some] + 1] - starts[4 * first[some]])
    order = np.lexsort((rank[choices], owner))
    begun = order[np.flatnonzero(np.diff(owner[order], prepend=-1))]
    path, conv, place = choices[begun], owner[begun], np.zeros(len(begun), np.int64)
    for power, jump in enumerate(pointers):
        more = jump[path]
        on_path = more < end
        path, conv, place = np.append(path, more[on_path]), np.append(conv, conv[on_path]), np.append(place, place[on_path] + (1 << power))
    order = np.lexsort((place, conv))
    path, conv = arcs[path[order]], conv[order]
    cut = np.searchsorted(conv, np.arange(len(convs) + 1))
    out = []
    for i in range(len(convs)):
        mine = path[cut[i] : cut[i + 1]]
        out.append((int(cost[first[i], START]), mine % 4, mine // 16 - first[i], mine // 4 % 4))
    return out


REPORT = pa.struct([
    ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()),
    ("audit", pa.string()), ("blocks", pa.list_(pa.struct([("block", pa.int64()), ("script", pa.string()), ("state", pa.int32()), ("place", pa.int64())]))),
])


def _gaps(blocks: list[dict]) -> int:
    """Turn numbers missing between the least and the greatest; blocks come in the order of turns and may share one at a border."""
    known = [b for b in blocks if b["kinds"]]
    if not known:
        return 0
    shared = sum(a["high"] == b["low"] for a, b in zip(known, known[1:]))
    return known[-1]["high"] - known[0]["low"] + 1 - (sum(b["kinds"] for b in known) - shared)


def _batches(convs: list[list[dict]]) -> Iterator[list[list[dict]]]:
    held, size = [], 0
    for c in convs:
        held.append(c)
        size += sum(len(b["codes"]) for b in c)
        if size >= BATCH:
            yield held
            held, size = [], 0
    if held:
        yield held


@F.arrow_udf(returnType=from_arrow_type(REPORT))
def _report(blocks: pa.Array) -> pa.Array:
    """Counts, cost and least script of each conversation, and the script cut up by block with the state and place each part begins with."""
    letters = np.frombuffer(LETTERS.encode(), np.uint8)
    out = []
    for some in _batches(blocks.to_pylist()):
        codes = [np.frombuffer("".join(b["codes"] for b in c).encode(), np.uint8).astype(np.int64) - 65 for c in some]
        for conv, code, (cost, edits, turns, states) in zip(some, codes, least_scripts(codes)):
            kind, fault = code // 4, code % 4
            legal = np.isin(kind[:-1] * 4 + kind[1:], [0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1])
            audit = letters[edits].tobytes().decode()
            places = np.cumsum(edits != 0)
            borders = np.cumsum([len(b["codes"]) for b in conv])[:-1]
            at = [0, *np.searchsorted(turns, borders), len(edits)]
            parts = [
                {"block": b["block"], "script": audit[i:j], "state": int(states[i]), "place": int(places[i - 1]) if i else 0}
                for b, i, j in zip(conv, at, at[1:]) if j > i
            ]
            out.append({
                "gaps": _gaps(conv), "blank": int((fault == BLANK).sum()), "duplicate": int((fault == DUPLICATE).sum()),
                "truncated": int((fault == TRUNCATED).sum()), "illegal": int((~legal).sum()), "cost": cost, "audit": audit, "blocks": parts,
            })
    return pa.array(out, REPORT)


EDIT = pa.list_(pa.struct([("src", pa.int32()), ("place", pa.int64()), ("role", pa.string())]))


@F.arrow_udf(returnType=from_arrow_type(EDIT))
def _edits(script: pa.Array, state: pa.Array, place: pa.Array, codes: pa.Array) -> pa.Array:
    """The turns that a block's part of a script emits: which turn of the block (null: inserted), where, and its new role (null: kept)."""
    out = []
    for letters, at, spot, code in zip(script.to_pylist(), state.to_pylist(), place.to_pylist(), codes.to_pylist()):
        rows, src = [], 0
        for x in letters:
            if x != "D":
                kept = x == "K"
                at = int(KEPT[at, (ord(code[src]) - 65) // 4] if kept else NEXT[at])
                rows.append({"src": None if x == "I" else src, "place": spot, "role": None if kept else ROLES[at]})
                spot += 1
            src += x != "I"
        out.append(rows)
    return pa.array(out, EDIT)


def content(role: Column, text: Column) -> Column:
    """128 bits that tell (role, text) apart."""
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))


def _rows(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    # a struct of a null is equal to another, as a bare null isn't
    return rows.select(
        F.struct(F.col(conv).alias("id")).alias("c"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    ).withColumn("h", content(F.col("role"), F.col("text")))


def repaired(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two frames: a report of each conversation (id, gaps, blank, duplicate, truncated, illegal, cost, audit) and its repaired turns (id, place, role, text).

    Turns stand in the order of ``turn``, nulls first; turns of one number in the order of a hash of role and text. A null role or text is one
    space, so a null text is blank; null conversation ids are one conversation. A blank turn or one whose role and text came before is
    deleted; so of repeated rows one stays. A role counts by its first letter. Very long texts are never held but in the rows they
    are in; of a conversation, one task gathers one letter a turn, as the audit does. An empty table gives two empty ones; columns
    of other names are left out.
    """
    given = _rows(rows, conv, turn, role, text)
    first = F.substring("role", 1, 1)
    kind = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(OTHER)
    fault = F.when(~F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")), BLANK).when(~F.rlike("text", F.lit(r"[.!?][\x20\x09-\x0D]*\z")), TRUNCATED).otherwise(SOUND)
    keys = given.select("c", "turn", "h", (kind * 4 + fault).alias("code"), F.monotonically_increasing_id().alias("nr"))
    order = ["c", "turn", "h", "nr"]  # nr lets rows that repeat one another be dealt apart
    placed = keys.repartitionByRange(*order).sortWithinPartitions(*order).drop("nr").withColumn("pos", F.monotonically_increasing_id())
    placed = common.saved(placed, "dialogue-turns")
    earliest = placed.groupBy("c", "h").agg(F.min("pos").alias("earliest"))
    repeats = (F.col("pos") > F.col("earliest")) & (F.col("code") % 4 != BLANK)
    judged = placed.join(earliest, ["c", "h"]).withColumn("code", F.when(repeats, F.col("code") - F.col("code") % 4 + DUPLICATE).otherwise(F.col("code")))
    blocks = judged.groupBy("c", F.shiftright("pos", BLOCK_BITS).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "code", "h"))).alias("rows"), F.min("turn").alias("low"), F.max("turn").alias("high"),
        F.size(F.collect_set("turn")).alias("kinds"),
    ).select(
        "c", "block", "low", "high", "kinds", F.transform("rows", lambda r: r["h"]).alias("hs"),
        F.array_join(F.transform("rows", lambda r: F.chr(r["code"] + 65)), "").alias("codes"),
    )
    blocks = common.saved(blocks, "dialogue-blocks")
    reports = blocks.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("block", "codes", "low", "high", "kinds"))).alias("blocks"))
    reports = common.saved(reports.select("c", _report("blocks").alias("r")), "dialogue-reports")
    scripts = reports.select("c", F.explode("r.blocks").alias("b")).select("c", "b.*").join(blocks.select("c", "block", "codes", "hs"), ["c", "block"])
    edits = scripts.select("c", "hs", F.explode(_edits("script", "state", "place", "codes")).alias("e")).select(
        "c", "e.place", F.col("e.role").alias("to"), F.when(F.col("e.src").isNotNull(), F.element_at("hs", F.coalesce(F.col("e.src"), F.lit(0)) + 1)).alias("h")
    )
    # a turn that stays is the only one of its conversation with its role and text that does
    source = given.groupBy("c", "h").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    kept = edits.filter(F.col("h").isNotNull()).join(source, ["c", "h"]).select("c", "place", F.coalesce("to", "role").alias("role"), "text")
    inserted = edits.filter(F.col("h").isNull()).select("c", "place", F.col("to").alias("role"), F.lit("").alias("text"))
    turns = kept.unionByName(inserted).select("c.id", "place", "role", "text")
    return reports.select("c.id", *[f"r.{f.name}" for f in REPORT if f.name != "blocks"]), turns


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows with faults put in by crc32("conv:turn") % 20, a null written as one space: 0 drops a row, 1 empties its text, 2 removes its
    marks of an end, 3 repeats it, 4 makes it a user's. Other columns stay; rows that repeat an id and turn get the same fault."""
    space = F.lit(" ")
    nr = F.crc32(F.concat(F.coalesce(F.col(conv).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space)).cast("binary")) % 20
    copies = common.fresh(rows, "_copies")
    t, r = F.coalesce(F.col(text), space), F.coalesce(F.col(role), space)
    return rows.filter(nr != 0).withColumns({
        text: F.when(nr == 1, "").when(nr == 2, F.regexp_replace(t, "[.!?]", "")).otherwise(t), role: F.when(nr == 4, "user").otherwise(r),
        copies: F.when(nr == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))),
    }).withColumn(copies, F.explode(copies)).drop(copies)


def digests(turns: DataFrame) -> DataFrame:
    """sha256 of each conversation's ``role:text`` lines in their order: (id, sha256). A digest of one text is made by one task."""
    line = F.concat("role", F.lit(":"), "text")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"])
    return turns.groupBy("id").agg(F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("sha256"))
