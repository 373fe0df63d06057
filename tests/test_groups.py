"""Files that no node or count tells apart are put together before nodes and counts are worked out."""

from pyspark.sql import functions as F

from __spark_entry__ import queries
from shelf.operators import counts
from shelf.operators.windows import numbered
from shelf.plans import tree
from shelf.plans.tree_queries import library, summary

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_groups_give_the_nodes_and_counts_of_their_files(spark):
    files, groups = library(spark, SF), summary(spark, SF)
    assert rows(tree.nodes(files)) == rows(tree.nodes(groups))
    assert rows(tree.node_counts(files)) == rows(tree.node_counts(groups)) == rows(tree.node_counts(summary(spark, SF, art=False)))
    shown = lambda lib: rows(tree.nodes(lib).drop("art_file_id"))
    assert shown(summary(spark, SF, art=False)) == shown(groups)


def test_copies_fall_into_few_groups(spark):
    """Films times directors times folders aren't told apart together: 600 files of 20 titles by 3 directors in 10 folders."""
    at = F.col("id")
    items = spark.range(600).select(
        at.alias("file_id"), F.lit(1).alias("root_id"), F.concat_ws("/", (at % 10).cast("string"), at.cast("string")).alias("rel_path"), F.concat(F.lit("t"), at % 20).alias("title"),
        F.lit(2000).alias("year"), F.lit(8.5).alias("rating"), F.lit("c").alias("collection"), F.lit("g").alias("genre"), (F.floor(at / 20) % 3).cast("string").alias("director"),
        F.lit(1920).alias("width"), F.lit(1080).alias("height"), (at > 300).alias("has_art"),
    )
    works, files = tree.split("movies", tree.grouped("movies", items))
    assert files.count() == 10 and works.count() == 20 * 3 + 20 * 2
    assert rows(counts.movie_counts(works)) == rows(counts.movie_counts(items)) and rows(counts.movie_totals(works)) == rows(counts.movie_totals(items))
    assert rows(counts.folder_counts(files)) == rows(counts.folder_counts(items)) == [(1, str(i), 60) for i in range(10)]


def test_folders_are_gathered_before_those_above_are_made(spark):
    files = spark.createDataFrame([(1, "a/b/x"), (1, "a/b/y"), (1, "a/z"), (1, "top"), (2, "a/b/c/d")], "root_id int, rel_path string")
    got = counts.folder_counts(files)
    assert rows(got) == [(1, "a", 3), (1, "a/b", 2), (2, "a", 1), (2, "a/b", 1), (2, "a/b/c", 1)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Generate"):]


def test_a_file_at_the_top_makes_no_folder(spark):
    lib = library(spark, SF)
    lib.files = spark.createDataFrame([(1, "top.mkv"), (1, "a/b/x.mkv")], "root_id int, rel_path string")
    ids = [r["node_id"] for r in tree.nodes(lib).filter("node_id like 'dir:1%' and parent_id like '%dir%'").collect() if r["node_id"].split(":")[1] == "1"]
    assert len(ids) == len(set(ids)) == 3


def test_listings_are_numbered_in_one_sort(spark):
    """Keys of an order are worked out before rows are sorted; nulls and ties stand as the order says."""
    items = spark.createDataFrame([(1, "b", 2), (2, "A", None), (3, "a", 5), (4, "B", 1), (5, None, 9)], "file_id long, name string, n int")
    got = numbered(items, [F.lower("name"), -F.col("n"), "file_id"], ["file_id"])
    assert got.columns == ["file_id", "nr"]
    assert [r["file_id"] for r in got.orderBy("nr").collect()] == [5, 2, 3, 1, 4] and rows(got.select("nr")) == [(i,) for i in range(5)]


def test_listing_orders_leave_no_sort_to_the_reader(spark):
    """What is left of the query when it returns is to read numbered rows, no listing passes one task."""
    got = queries()["l3_listing_orders"](spark, SF)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "Sort " not in plan and "Limit" not in plan
    counted = got.groupBy("listing").agg(F.min("pos").alias("low"), F.max("pos").alias("high"), F.count_distinct("pos").alias("n")).collect()
    assert len(counted) == 7 and all(r["low"] == 1 and r["high"] == r["n"] for r in counted)
