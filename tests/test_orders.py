"""Order keys of the tree against plain comparison, and alignments whose hashes are dealt by a salt against plain counting."""

import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelf.operators import segments
from shelf.plans import tree
from shelf.plans.tree_queries import library
from shelf.session import checkpoint_dir
from shelf.sources.bridge import tasks_for


def test_number_keys_sort_as_numbers(spark):
    values = [None, -2_000_000_000.0, -8.7, -8.65, -1.0, 0.0, 0.5, 1.0, 2.0, 10.0, 1_999.0, 20_240_101.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").withColumn("k", tree.number_key(F.col("v")))
    assert [r["i"] for r in df.orderBy("k").collect()] == list(range(len(values)))


def test_id_keys_sort_as_ids(spark):
    values = [-(2**61), -7, 0, 3, 10, 2**61]
    df = spark.createDataFrame([(v,) for v in values], "v long").withColumn("k", tree.id_key(F.col("v")))
    assert [r["v"] for r in df.orderBy("k").collect()] == values


def test_a_walk_takes_folders_before_the_files_beside_them(spark):
    paths = ["b/z.mkv", "a/x/1.mkv", "a/y.mkv", "top.mkv", "A b/q.mkv", "a/x/deep/er/2.mkv"]
    items = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "file_id long, p string").select(
        "file_id", F.lit("movies").alias("kind"), F.lit("").alias("at"), tree.joined_key(F.lit("/vol")).alias("view"), F.lit(1).cast("long").alias("folder_root"),
        tree.folder_of(F.col("p")).alias("folder"), F.concat(tree.joined_key(F.lower(F.substring_index("p", "/", -1))), tree.id_key(F.col("file_id"))).alias("key"),
    )
    items = items.withColumn("node_id", tree.K.dir_id(F.lit(1), F.col("folder")))
    flat = tree.flatten(items)
    walk = lambda scope: [paths[r["file_id"]] for r in flat.filter(F.col("scope") == scope).orderBy("place").collect()]
    assert walk("dir:1") == walk("mv:dir") == ["a/x/deep/er/2.mkv", "a/x/1.mkv", "a/y.mkv", "A b/q.mkv", "b/z.mkv", "top.mkv"]


def test_places_are_counted_from_one_in_every_container(spark):
    """Listings sorted once give the places of all containers, also where children overlap."""
    rng = random.Random(4)
    rows = [(f"mv:genre:{g}", i, tree.MARK.join([name, ""]), f"{rng.randrange(5)}{tree.MARK}{i:04d}") for g, name in ((1, "b"), (2, "a"), (3, "c")) for i in range(120) if rng.random() < 0.6]
    rows += [("mv:all", i, "", f"{i % 7}{tree.MARK}{i:04d}") for i in range(120)]
    items = spark.createDataFrame(rows, "node_id string, file_id long, at string, key string").withColumns({
        "kind": F.lit("movies"), "view": F.lit(""), "folder_root": F.lit(None).cast("long"), "folder": F.lit(None).cast("string")})
    got = {}
    for r in tree.flatten(items).collect():
        got.setdefault(r["scope"], {})[r["place"]] = r["file_id"]
    order = sorted((at, key, i) for node, i, at, key in rows if node != "mv:all")
    want = {"mv:genre": list(dict.fromkeys(i for _, _, i in order))}
    for node, scopes in (("mv:all", ["mv:all", "mv", "0"]), *[(f"mv:genre:{g}", [f"mv:genre:{g}"]) for g in (1, 2, 3)]):
        for scope in scopes:
            want[scope] = [i for key, i in sorted((key, i) for n, i, _, key in rows if n == node)]
    assert {s: [p[k + 1] for k in range(len(p))] for s, p in got.items()} == want
    placed = {}
    for r in tree.places(items).collect():
        placed.setdefault(r["node_id"], {})[r["place"]] = r["file_id"]
    assert all([placed[n][k + 1] for k in range(len(placed[n]))] == want[n] for n in placed) and len(placed) == 4


def test_only_the_listings_asked_for_are_made(spark):
    """A listing is the same by itself as among all, and needs no table but its own."""
    lib = library(spark, "/root/testdata/sf0.001")
    alone = tree.Library(movies=lib.movies.drop("mime", "duration_ms", "rel_path"), episodes=None, tv_series=None, tracks=None, files=None, roots=None)
    shown = ["node_id", "file_id", "title", "key", "at"]
    whole = tree.node_items(lib).filter("node_id like 'mv:%' and node_id not like 'mv:dir%'").select(*shown)
    for leaves in (["mv:genre"], ["mv:year", "mv:4k"], ["mv:rating", "mv:set", "mv:recent"]):
        kept = F.lit(False)
        for leaf in leaves:
            kept = kept | (F.col("node_id") == leaf) | F.col("node_id").startswith(leaf + ":")
        got = tree.node_items(alone, leaves=leaves, fields=["title"])
        assert [x for x in tree.ITEM_FIELDS if x in got.columns] == ["kind", "title"]
        rows = lambda df: sorted(map(tuple, df.select(*shown).collect()))
        assert rows(got) == rows(whole.filter(kept)) != []


def scratch_names(spark):
    """What has been written so far, by name, with the rows of each."""
    at = Path(checkpoint_dir(spark).removeprefix("file:")) / f"tables-{spark.sparkContext.applicationId}"
    return {x.name for x in at.iterdir()} if at.exists() else set()


def own_library(spark):
    """Three albums of two artists, one title in two spellings of a genre, and two films, as the frames of a library without paths."""
    tracks = [(-i, 20, f"a{i % 2}/b{i % 3}", 20240101 + i, f"T{i}", f"a{i % 2}", None, f"b{i % 3}", 1, i, 1990, "Rock" if i % 2 else "rock") for i in range(1, 13)]
    t = spark.createDataFrame(tracks, "file_id long, root_id int, folder string, added_at int, title string, artist string, album_artist string, album string, disc_no int, track_no int, year int, genre string")
    name = F.array(F.struct(tree.dimension_id(F.col("genre")).alias("id"), F.col("genre").alias("name")))
    t = t.withColumn("genres", name)
    files = t.select("file_id", F.lit("music").alias("kind"), "root_id", "folder", "title", "year", "artist", "album")
    return tree.Library(movies=None, episodes=None, tv_series=None, tracks=t, files=files, roots=spark.createDataFrame([(20, "music", "/vol/Music")], "root_id int, kind string, path string"))


def test_listings_of_the_librarys_own_rows_are_not_written_again(spark):
    lib, before = own_library(spark), scratch_names(spark)
    items = tree.node_items(lib, leaves=["mu:album", "mu:genre", "dir"], fields=["title"])
    assert scratch_names(spark) == before
    got = {}
    for r in tree.places(items).collect():
        got.setdefault(r["node_id"].split(":")[0] + ":" + r["node_id"].split(":")[1], []).append((r["node_id"], r["place"], r["file_id"]))
    assert {k: len(v) for k, v in got.items()} == {"mu:album": 12, "mu:genre": 12, "dir:20": 12}
    # one genre, in the order of its titles
    assert [-f for _, _, f in sorted(got["mu:genre"])] == [1, 10, 11, 12, 2, 3, 4, 5, 6, 7, 8, 9]
    for _, place, f in got["mu:album"]:
        assert place == len([g for g in range(1, 13) if g % 6 == -f % 6 and g <= -f])


def test_items_are_sorted_by_their_id_once(spark):
    """The id that ends a key isn't shuffled beside the id itself, and orders items of one title all the same."""
    rows = [("n", i, f"{'x' if i % 2 else 'X'}{i % 3}") for i in (-(2**40), -5, -4, 0, 7, 8, 9, 2**40)]
    items = spark.createDataFrame(rows, "node_id string, file_id long, title string").withColumn("key", F.concat(tree.joined_key(F.lower("title")), tree.id_key(F.col("file_id"))))
    node, key, last = tree.listed_order()
    assert (node, last) == ("node_id", "file_id") and {r[0] for r in items.select(key).collect()} == {f"x{k}{tree.MARK}" for k in range(3)}
    got = {r["place"]: r["file_id"] for r in tree.places(items).collect()}
    assert [got[k + 1] for k in range(len(rows))] == [i for _, i, _ in sorted(rows, key=lambda r: (r[2].lower(), r[1]))]


def test_leaves_under_every_container_are_those_scopes_names(spark):
    lib = library(spark, "/root/testdata/sf0.001")
    leaf = F.when(F.col("node_id").startswith("dir:"), "dir").otherwise(F.concat_ws(":", F.slice(F.split("node_id", ":"), 1, 2)))
    over = tree.leaves_of(tree.node_items(lib, fields=[])).select(leaf.alias("leaf"), F.explode("scopes.scope").alias("scope")).distinct()
    found = over.groupBy("scope").agg(F.array_sort(F.collect_set("leaf")).alias("want")).withColumn("got", F.array_sort(tree.leaves_under(F.col("scope"))))
    assert found.filter("got <> want").collect() == [] and found.count() > 100
    asked = spark.createDataFrame([("mv",), ("dir:3:x",), ("nothing",), (None,)], "scope string")
    assert tree.asked_leaves(asked) == ["mv:all", "dir"] and tree.asked_leaves(asked.filter("scope = 'nothing'")) == tree.LISTINGS


def test_an_unwanted_first_place_hides_the_wanted_ones_behind_it(spark):
    rows = [("mv:genre:1", 1, "a" + tree.MARK, "old"), ("mv:genre:2", 1, "b" + tree.MARK, "new"), ("mv:genre:1", 2, "a" + tree.MARK, "new"), ("mv:genre:2", 3, "b" + tree.MARK, "new"), ("mv:genre:2", 4, "b" + tree.MARK, "old")]
    items = spark.createDataFrame(rows, "node_id string, file_id long, at string, title string").withColumns({
        "kind": F.lit("movies"), "key": tree.id_key(F.col("file_id")), "view": F.lit(""), "folder_root": F.lit(None).cast("long"), "folder": F.lit(None).cast("string")})
    shown = lambda *wanted: sorted((r["file_id"], r["title"]) for r in tree.scope_items(items, "mv:genre", *wanted).collect())
    assert shown() == [(1, "old"), (2, "new"), (3, "new"), (4, "old")] and shown(F.col("title") == "new") == [(2, "new"), (3, "new")]


@pytest.mark.parametrize("crowd", [2, 256])
def test_votes_against_plain_counting(spark, monkeypatch, crowd):
    monkeypatch.setattr(segments, "CROWD", crowd)
    rng = random.Random(3)
    shared = [rng.randrange(1 << 12) for _ in range(40)]
    files = {}
    for f in range(7):
        body = [rng.randrange(60) for _ in range(50)]
        at = rng.randrange(10)
        files[f] = [*body[:at], *shared, *body[at:], *[7] * (3 if f % 2 else 20)]  # 7 is hot in some files and not in others
    rows = [("s", "head", f, f // 2, i, h << 20) for f, hs in files.items() for i, h in enumerate(hs)]
    m = segments.Matching(top_offsets=None, min_votes=6)
    got = {(r["a_id"], r["b_id"], r["offset"]): r["votes"] for r in segments.votes(spark.createDataFrame(rows, "season string, part string, file_id long, episode long, pos long, item long"), m).collect()}
    want = Counter()
    for a in files:
        cap = max(len(files[a]) // 32, 4)
        uses = Counter(files[a])
        for b in files:
            if (a // 2, a) < (b // 2, b) and a // 2 != b // 2:
                for i, x in enumerate(files[a]):
                    for j, y in enumerate(files[b]):
                        if x == y and uses[x] <= cap:
                            want[a, b, i - j] += 1
    assert got == {k: v for k, v in want.items() if v >= 6}


def test_head_and_tail_are_cut_from_either_end(spark):
    items = spark.range(1000).select(F.lit("s").alias("season"), F.lit(1).alias("file_id"), F.lit(1).alias("episode"), F.col("id").alias("pos"), F.col("id").alias("item"))
    got = segments.head_and_tail(items, segments.Matching(item_s=1.0)).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("item").alias("low"), F.max("pos").alias("top")).collect()
    assert {r["part"]: (r["n"], r["low"], r["top"]) for r in got} == {"head": (600, 0, 599), "tail": (300, 700, 299)}


def test_votes_and_matches_leave_no_pairings_behind(spark):
    """Sixty files of one season that share frequent hashes: what is shuffled or returned follows the files, not their pairs."""
    rng = random.Random(5)
    rows = [("s", "head", f, f, i, rng.randrange(40) << 20) for f in range(60) for i in range(200)]
    prints = spark.createDataFrame(rows, "season string, part string, file_id long, episode long, pos long, item long")
    cells = segments.dealt(prints)
    assert cells.agg(F.sum(F.size("pos"))).first()[0] == len(rows)
    plan = segments.votes(prints, segments.Matching(min_votes=20))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate explode(met" not in plan


def test_places_paired_a_few_at_a_time_agree_with_all_at_once(monkeypatch):
    rng = np.random.default_rng(1)
    file, at, pos = np.repeat(np.arange(9), 50), np.tile(np.arange(50), 9), np.arange(50)
    key = (rng.integers(0, 12, 450) << 32) + file
    order = np.argsort(key, kind="stable")
    call = lambda: np.concatenate(list(segments._agreeing(pos, pos % 12, key[order], at[order], 50, (2, 9), 5)), axis=1)
    whole = call()
    monkeypatch.setattr(segments, "PAIRED", 300)
    assert whole.shape[1] > 50 and call().tolist() == whole.tolist()


def test_matches_where_a_print_has_gaps(spark):
    rows = [("s", "head", f, f, i, i << 8) for f in (1, 2) for i in range(3, 40) if (f, i) not in ((1, 9), (2, 20))]
    prints = spark.createDataFrame(rows, "season string, part string, file_id long, episode long, pos long, item long")
    ways = spark.createDataFrame([("s", "head", 1, 2, 0, 12, 1)], "season string, part string, a_id long, b_id long, offset long, votes long, vote_rank int")
    got = [r["pos"] for r in segments.aligned(prints, ways, segments.Matching(max_bits=0)).collect()]
    assert sorted(got) == [i for i in range(3, 40) if i not in (9, 20)]


SHARED = segments.Matching(item_s=0.5, min_votes=6, top_offsets=4)
PRINTS = "season string, part string, file_id long, episode long, pos long, item long"


def shared_prints(spark):
    """Files of two seasons that share passages of 40 items; one has gaps, one begins late, one has an item twice and one has two passages."""
    rng = random.Random(11)
    passages = [[rng.randrange(1 << 32) for _ in range(40)] for _ in range(2)]
    rows = []
    for f in range(9):
        body = [rng.randrange(1 << 32) for _ in range(60)]
        items = [*body[: 5 * f], *passages[0], *body[5 * f :], *(passages[1] if f % 3 == 0 else [])]
        rows += [(f"s{f % 9 // 7}", "head", f, f // 2 if f < 4 else f, i + 3 * (f == 5), x) for i, x in enumerate(items) if not (f == 2 and i % 17 == 0)]
    return spark.createDataFrame([*rows, rows[30]], PRINTS)


def same_rows(got, want):
    rows = sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == rows and len(rows) > 5


def no_pairs_shuffled(df):
    """One exchange brings prints to the cells, and none comes after them."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.index("FlatMapGroupsInArrow") < plan.index("Exchange hashpartitioning(season")


@pytest.mark.parametrize("crowd", [2, 256])
def test_shared_items_against_alignments_joined(spark, monkeypatch, crowd):
    monkeypatch.setattr(segments, "CROWD", crowd)
    prints = shared_prints(spark)
    got = segments.shared_items(prints, SHARED)
    no_pairs_shuffled(got)
    same_rows(got, segments.aligned(prints, segments.votes(prints, SHARED), SHARED))


@pytest.mark.parametrize("lot", [50, 1 << 18])
def test_shared_runs_against_runs_of_aligned_items(spark, monkeypatch, lot):
    monkeypatch.setattr(segments, "LOT", lot)
    monkeypatch.setattr(segments, "PAIRED", lot)
    prints = shared_prints(spark)
    got = segments.shared_runs(prints, SHARED)
    no_pairs_shuffled(got)
    same_rows(got, segments.runs(segments.aligned(prints, segments.votes(prints, SHARED), SHARED), SHARED))


def test_shared_spans_against_spans_of_runs(spark):
    prints = shared_prints(spark)
    got = segments.shared_spans(prints, SHARED)
    no_pairs_shuffled(got)
    same_rows(got, segments.spans(segments.runs(segments.aligned(prints, segments.votes(prints, SHARED), SHARED), SHARED), prints, SHARED))


def told_spans(spark, prints, m):
    """The first span of each pair that starts in the first half of both files, told to both."""
    found = {}
    half = {r["file_id"]: r["n"] * m.item_s / 2 for r in prints.groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    for r in sorted(segments.spans(segments.runs(segments.aligned(prints, segments.votes(prints, m), m), m), prints, m).collect(), key=lambda r: r["place"]):
        if r["part"] == "tail" or (r["a_start"] < half[r["a_id"]] and r["b_start"] < half[r["b_id"]]):
            found.setdefault((r["season"], r["part"], r["a_id"], r["b_id"]), r)
    return [(s, p, r[f"{x}_id"], r[f"{x}_start"], r[f"{x}_end"]) for (s, p, _, _), r in found.items() for x in "ab"]


def test_chosen_spans_leave_the_cell_alone(spark):
    prints = shared_prints(spark)
    prints = prints.unionByName(prints.withColumn("part", F.lit("tail")))
    files = prints.filter("part = 'head'").groupBy("season", "file_id").agg((F.count(F.lit(1)) * SHARED.item_s).alias("duration_s"))
    got = segments.chosen_spans(prints, files, SHARED)
    no_pairs_shuffled(got)
    want = told_spans(spark, prints.filter("part = 'head'"), SHARED) + told_spans(spark, prints.filter("part = 'tail'"), SHARED)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 20


def test_counted_spans_have_the_medians_of_all(spark):
    prints = shared_prints(spark)
    files = prints.groupBy("season", "file_id").agg((F.count(F.lit(1)) * SHARED.item_s).alias("duration_s"))
    told = segments.chosen_spans(prints, files, SHARED)
    counts = segments.chosen_counts(prints, files, SHARED)
    assert counts.count() < 2 * told.count()
    needs = spark.createDataFrame([("s0", 2), ("s1", 1)], "season string, need int")
    same_rows(segments.consensus_of_counts(counts, needs), segments.consensus(told, needs))


def test_lists_of_a_print_are_cut_and_dealt_as_their_items_are(spark):
    """One file has two lists, the longer of which tells where its tail begins."""
    m = segments.Matching(item_s=1.0, head_s=6.0, tail_s=4.0)
    lists = spark.createDataFrame([("s", 1, 1, list(range(20))), ("s", 2, 2, list(range(3))), ("s", 3, 3, list(range(9))), ("s", 3, 3, list(range(7)))], "season string, file_id long, episode long, item array<long>")
    lists = lists.withColumns({"n": F.size("item"), "part": F.lit("head"), "pos": F.lit(None).cast("array<int>")})
    rows = lists.select("season", "part", "file_id", "episode", F.posexplode("item").alias("pos", "item"))
    found = segments.ends(lists, m)
    places = found.select("part", "file_id", F.posexplode("item").alias("pos", "item"))
    want = segments.head_and_tail(rows.drop("part"), m).select("part", "file_id", "pos", "item")
    assert sorted(map(tuple, places.collect())) == sorted(map(tuple, want.collect()))
    assert sorted(tuple(r) for r in segments.votes(lists, segments.Matching(min_votes=1)).collect()) == sorted(tuple(r) for r in segments.votes(rows, segments.Matching(min_votes=1)).collect())


def test_medians_are_ranked_in_two_sorts_and_as_many_tasks_as_asked(spark):
    rng = random.Random(8)
    rows = [(f"s{i % 3}", "head", i % 7, float(rng.randrange(40)), float(rng.randrange(30, 90))) for i in range(300)]
    told = spark.createDataFrame(rows, "season string, part string, file_id long, start double, end double")
    needs = spark.createDataFrame([("s0", 1), ("s1", 2), ("s2", 15)], "season string, need int")
    ranked = segments.consensus(told, needs, 40)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 2 and "hashpartitioning(season#" in plan and ", 40), REPARTITION_BY_NUM" in plan
    groups = {}
    for season, _, f, a, b in rows:
        groups.setdefault((season, f), []).append((a, b))
    want = set()
    for (season, f), found in groups.items():
        start, end = (sorted(x)[len(found) // 2] for x in zip(*found))
        if len(found) >= {"s0": 1, "s1": 2, "s2": 15}[season] and end > start:
            want.add((season, f, start, end))
    assert {(r["season"], r["file_id"], r["start"], r["end"]) for r in ranked.collect()} == want


def test_a_larger_table_is_sorted_in_more_tasks(spark, tmp_path):
    counts = []
    for n in (1, 24):
        spark.range(n * 1000).repartition(n).write.parquet(f"{tmp_path}/{n}/lineitem.parquet")
        counts.append(tasks_for(spark, f"{tmp_path}/{n}", "lineitem"))
    assert counts[0] < counts[1]
