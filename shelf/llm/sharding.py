"""Sharding by balanced label propagation: linked documents begin in shards cut from a hash-random order of their groups and move in
rounds to shards where more of their neighbours are, within quotas."""

from __future__ import annotations

from collections import Counter
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelf.llm import common

SHARDS = 40
#: Positions of a link that meet the link's parts in one join key.
BLOCK = 1024


def _pick(values: list, at: Column) -> Column:
    """The value at a shard's number; one literal a shard."""
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), (at + 1).cast("int"))


def _loads(parts: DataFrame, shards: int) -> list[int]:
    """Rows of the parts in each shard: one number a shard comes to the driver."""
    found = {r["shard"]: r["n"] for r in parts.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [found.get(j, 0) for j in range(shards)]


def granted(asked: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """Rows that may go from one shard to another, of the ``asked`` sums by (from, to): into free room first, then around cycles of
    asking shards, which leave every load as it is. Both arguments have at most shards squared numbers."""
    left, given, room = dict(asked), Counter(), list(room)

    def give(arcs: list[tuple[int, int]], n: int) -> None:
        for arc in arcs:
            left[arc] -= n
            given[arc] += n

    moved = True
    while moved:
        moved = False
        for i, j in sorted(left, key=lambda arc: (-left[arc], arc)):
            if (n := min(left[i, j], room[j])) > 0:
                give([(i, j)], n)
                room[i] += n
                room[j] -= n
                moved = True
    for i, j in sorted(left, key=lambda arc: (-left[arc], arc)):
        while left[i, j] and (back := _path(left, j, i)):
            arcs = [(i, j), *back]
            give(arcs, min(left[arc] for arc in arcs))
    return {arc: n for arc, n in given.items() if n}


def _path(left: dict[tuple[int, int], int], begin: int, end: int) -> list[tuple[int, int]]:
    """A shortest way from ``begin`` to ``end`` over arcs on which rows are left; empty if there is none."""
    after: dict[int, list[int]] = {}
    for (i, j), n in sorted(left.items()):
        if n:
            after.setdefault(i, []).append(j)
    came, queue = {begin: None}, [begin]
    for i in queue:
        for j in after.get(i, ()):
            if j not in came:
                came[j] = i
                queue.append(j)
    way = []
    while came.get(end) is not None:
        way.append((came[end], end))
        end = came[end]
    return way[::-1]


def _exchanges(asked: DataFrame, split: DataFrame, whole: DataFrame, turn: int) -> list[tuple[str, int, int, int]]:
    """Exchanges of as many rows of two links between two full shards, as moves (link, shard, to, move).

    A part joins its link's other part and rows of the smallest part there that is as large take its place: what the first gains
    in edges is more than what the second loses. A turn has one exchange a shard, so at most ``shards`` moves come to the driver.
    """
    both = asked.select("link", "shard", "to", "n", "held").unionAll(asked.select("link", "to", "shard", "held", "n"))
    best = F.min_by(F.struct("link", "n", "held"), F.struct("n", F.xxhash64(F.lit(turn), "link")))
    asks = both.groupBy("shard", "to").agg(best.alias("a")).select("shard", "to", "a.*")
    # two links of each size a shard, as one may be the asking one
    sizes = split.unionByName(whole).groupBy(F.col("shard").alias("there"), F.col("n").alias("size")).agg(F.min("link").alias("low"), F.max("link").alias("high"))
    other = F.when(F.col("low") != F.col("link"), F.col("low")).when(F.col("high") != F.col("link"), F.col("high"))
    fits = (F.col("there") == F.col("to")) & (F.col("size") >= F.col("n")) & (F.col("size") - F.col("n") < F.col("held"))
    found = (
        asks.join(sizes, fits).withColumn("other", other).filter("other is not null")
        .groupBy("shard", "to", "link", "n", "held").agg(F.min(F.struct("size", "other")).alias("m")).collect()  # at most shards squared rows
    )
    used: set = set()
    moves = []
    for r in sorted(found, key=lambda r: (-r["n"] * (r["held"] + r["n"] - r["m"]["size"]), r["shard"], r["to"])):
        takes = {r["shard"], r["to"], r["link"], r["m"]["other"]}
        if not takes & used:
            used |= takes
            moves += [(r["link"], r["shard"], r["to"], r["n"]), (r["m"]["other"], r["to"], r["shard"], r["n"])]
    return moves


def _pieces(parts: DataFrame) -> DataFrame:
    """Parts with the number of parts of their link, written; a link has one part a shard at most."""
    return common.saved(parts.select("link", "shard", "n", F.count(F.lit(1)).over(Window.partitionBy("link")).alias("pieces")), "shard-parts")


def propagate(parts: DataFrame, quotas: list[int], rounds: int | None = None, seed: str = "shard", log: list | None = None) -> DataFrame:
    """Move rows between the (link, shard, n) parts of linked rows; returns the parts after two rounds in a row without a move, or
    after ``rounds`` if given.

    Rows of one link in one shard are alike, so a round moves counts and no hot link is gathered. The smaller parts of a link ask
    to join its larger ones (the smallest the largest, and so on; ties by a hash that changes with the round); every second round
    they ask only for shards with room. What may go from shard to shard is settled by sums (``granted``), who goes by a hash-random
    order; where nothing may, shards exchange rows of two links (``_exchanges``). Each move leaves fewer cut edges, so there is a last
    one. Links in one piece leave the rounds, unless an exchange takes them up. ``log`` gets a dict a round: turn, moved
    rows, and the edges that splits cut after it.
    """
    spark, shards = parts.sparkSession, len(quotas)
    loads = _loads(parts, shards)
    parts = _pieces(parts)
    split, whole = (parts.filter(c).select("link", "shard", "n") for c in ("pieces > 1", "pieces = 1"))
    idle = 0
    for turn in count() if rounds is None else range(rounds):
        room = [q - n for q, n in zip(quotas, loads)]
        roomy = (_pick(room, F.col("shard")) > 0) if turn % 2 else F.lit(True)
        order = Window.partitionBy("link").orderBy(F.desc(roomy), F.desc("n"), F.xxhash64(F.lit(turn), "link", "shard"), "shard")
        all_ = F.collect_list(F.struct("shard", "n")).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # one a shard
        placed = split.filter(F.col("n") < _pick(quotas, F.col("shard"))).withColumn("place", F.row_number().over(order)).withColumn("all", all_)
        asked = (
            placed.filter(2 * F.col("place") > F.size("all") + 1).withColumn("with", F.element_at("all", -F.col("place")))
            .select("link", "shard", "n", F.col("with.shard").alias("to"), F.col("with.n").alias("held"))
            .filter("held >= n").withColumn("key", common.order_key(f"{seed}{turn}", F.col("link"), F.col("shard")))
        )
        asked = common.saved(asked, "shard-asked")
        wanted = {(r["shard"], r["to"]): r["n"] for r in asked.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()}
        given = granted(wanted, room)
        taken = None
        if given:
            gives = spark.createDataFrame([(i, j, n) for (i, j), n in given.items()], "shard int, to int, give long")
            moves = common.ranked(asked, ["shard", "to"], "key", "n", "ahead", ["link"]).join(F.broadcast(gives), ["shard", "to"])
            moves = moves.withColumn("move", F.least(F.col("n"), F.col("give") - F.col("ahead"))).filter("move > 0").select("link", "shard", "to", "move")
        else:
            pairs = _exchanges(asked, split, whole, turn) if wanted else []
            if not pairs:
                idle += 1
                if idle == 2 or not wanted and turn % 2 == 0:
                    break
                continue
            moves = spark.createDataFrame(pairs, "link string, shard int, to int, move long")
            links = F.broadcast(moves.select("link").distinct())
            taken = whole.join(links, "link", "left_semi").select("link", "shard", "n")
            whole = common.saved(whole.join(links, "link", "left_anti").select("link", "shard", "n"), "shard-whole")
            given = Counter()
            for _, i, j, n in pairs:
                given[i, j] += n
        idle = 0
        for (i, j), n in given.items():
            loads[i] -= n
            loads[j] += n
        changes = moves.select("link", "shard", (-F.col("move")).alias("n")).unionAll(moves.select("link", F.col("to").alias("shard"), F.col("move").alias("n")))
        before = split if taken is None else split.unionByName(taken)
        parts = _pieces(before.unionByName(changes).groupBy("link", "shard").agg(F.sum("n").alias("n")).filter("n > 0"))
        split = parts.filter("pieces > 1").select("link", "shard", "n")
        whole = whole.unionByName(parts.filter("pieces = 1").select("link", "shard", "n"))
        if log is not None:
            log.append({"turn": turn, "moved": sum(given.values()), "cut": cut_edges(split)})
    return whole.unionByName(split)


def cut_edges(parts: DataFrame) -> int:
    """Pairs of rows of one link that are not in one shard."""
    links = parts.groupBy("link").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("inside"))
    return links.agg(F.coalesce(F.sum((F.col("m") * F.col("m") - F.col("inside")) / 2), F.lit(0))).first()[0]


def cut(groups: DataFrame, quotas: list[int]) -> DataFrame:
    """The first (link, shard, n) parts of ``groups`` (link, mates, key): in hash-random order, cut where each shard has its share.

    At most one group is split at the border of two shards, besides those larger than a share. A shard's share is that part of its
    quota which linked rows are of all, so each has room for moves as far as there are rows without a neighbour.
    """
    linked = groups.agg(F.sum("mates").alias("n")).first()["n"] or 0
    rows = sum(quotas)
    begins = [linked * sum(quotas[:j]) // rows if rows else 0 for j in range(len(quotas) + 1)]
    begun = F.array(*[F.lit(int(b)).cast("long") for b in begins[:-1]])
    shard = lambda x: F.size(F.filter(begun, lambda b: b <= x)) - 1
    last = F.col("ahead") + F.col("mates") - 1
    spread = common.ranked(groups, [], "key", "mates", "ahead", ["link"]).withColumn("shard", F.explode(F.sequence(shard(F.col("ahead")), shard(last))))
    n = F.least(last + 1, _pick(begins[1:], F.col("shard")).cast("long")) - F.greatest(F.col("ahead"), _pick(begins[:-1], F.col("shard")).cast("long"))
    return spread.select("link", F.col("shard").cast("int").alias("shard"), n.cast("long").alias("n")).filter("n > 0")


def assign(docs: DataFrame, link: Column, id: str = "doc_id", shards: int = SHARDS, rounds: int | None = None, seed: str = "shard") -> DataFrame:
    """All columns of ``docs`` as a struct ``row``, with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in its shard).

    Rows are linked when they share a ``link`` value (a hyperedge; null links nothing). Shards differ by one row at most. Linked
    rows start as ``cut`` leaves them and move by ``propagate``; a row without a neighbour cuts no edge anywhere, so these fill
    what the quotas leave. Rows that repeat are rows of their own, a null id counts as an empty one, an empty table gives no rows.
    """
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id).alias("id"), link.alias("link"))
    base = base.withColumn("key", common.order_key(seed, F.col("id"), F.col("link"))).withColumn("one", F.lit(1).cast("long"))
    alone = common.order_key(f"{seed}-alone", F.col("id"), F.monotonically_increasing_id())
    base = common.saved(base.withColumn("link", F.coalesce(F.col("link").cast("string"), F.concat(F.lit("-"), alone))), "shard-rows")
    base = common.saved(common.ranked(base, ["link"], "key", "one", "pos", whole="mates"), "shard-places")
    linked, single = base.filter("mates > 1"), base.filter("mates = 1")
    counts = base.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    quotas = [counts // shards + (j < counts % shards) for j in range(shards)]
    groups = linked.filter("pos = 0").select("link", F.col("mates").cast("long").alias("mates"), common.order_key(seed, F.col("link")).alias("key"))
    groups = common.saved(groups, "shard-groups")
    parts = common.saved(cut(groups, quotas), "shard-parts")
    parts = common.saved(propagate(parts, quotas, rounds, seed), "shard-settled")
    loads = _loads(parts, shards)

    first = F.coalesce(F.sum("n").over(Window.partitionBy("link").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    keyed = common.saved(parts.withColumn("first", first).withColumn("key", common.order_key(seed, F.col("link"))), "shard-first")
    seats = common.ranked(keyed, ["shard"], "key", "n", "seat", ["link"]).select(
        F.col("link").alias("l"), "shard", "first", "n", "seat",
        F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor((F.col("first") + F.col("n") - 1) / BLOCK))).alias("b"),
    )
    on = (F.col("link") == F.col("l")) & (F.floor(F.col("pos") / BLOCK) == F.col("b"))
    inside = (F.col("pos") >= F.col("first")) & (F.col("pos") < F.col("first") + F.col("n"))
    together = linked.join(seats, on & inside).select("row", "shard", (F.col("seat") + F.col("pos") - F.col("first")).alias("slot"))

    gaps = [q - n for q, n in zip(quotas, loads)]
    begins = [sum(gaps[:j]) for j in range(shards)]
    begun = F.size(F.filter(F.array(*[F.lit(int(b)) for b in begins]), lambda x: x <= F.col("rank")))
    # shards without a gap begin where the next one does, so the last that has begun is the one that has room
    alone = (
        common.ranked(single, [], "key", "one", "rank", ["link"]).withColumn("shard", (begun - 1).cast("int"))
        .select("row", "shard", (_pick(loads, F.col("shard")) + F.col("rank") - _pick(begins, F.col("shard"))).alias("slot"))
    )
    return together.unionAll(alone).select("row", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))
