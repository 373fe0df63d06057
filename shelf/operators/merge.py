"""Copies of one work merged into one item with its best copy first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelf.operators.windows import ordered_columns

COPY = ["file_id", "mime", "size", "duration_ms", "width", "height"]


def pixels(width: str = "width", height: str = "height") -> Column:
    return (F.coalesce(F.col(width), F.lit(0)) * F.coalesce(F.col(height), F.lit(0))).cast("long")


def movie_keys() -> dict[str, Column]:
    """Same title in any case and same year: one movie."""
    return {"k_title": F.lower("title"), "k_year": F.col("year")}


def episode_keys() -> dict[str, Column]:
    """Same season and number within a series: one episode."""
    return {"k_series": F.lower("series"), "k_season": F.col("season"), "k_episode": F.col("episode")}


def merge_renditions(
    items: DataFrame,
    keys: dict[str, Column],
    carry: Sequence[str],
    order: Sequence[Column] = (),
    copy: Sequence[str] = COPY,
) -> DataFrame:
    """One row per key: described by its first row in ``order``, played from its best copy.

    ``order`` is a list of ascending numeric columns ending in a unique one (file_id by
    default), ``copy`` the columns wanted of the best copy. Every output is a partial aggregate, so a key holding many copies never
    lands in one task whole; the copies themselves are listed by ``renditions``.
    """
    order = list(order) or [F.col("file_id")]
    first = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    quality = F.struct(
        pixels().alias("px"), F.col("size").alias("size"), *[(-c).alias(f"r{i}") for i, c in enumerate(order)]
    )
    merged = items.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(
        F.min_by(F.struct(*carry), first).alias("_first"),
        F.min(first).alias("_ord"),
        F.max_by(F.struct(*copy), quality).alias("_best"),
        (F.count(F.lit(1)) - 1).alias("extras"),
        F.min_by(F.col("has_art"), first).alias("_first_art"),
        F.min_by(F.when(F.col("has_art"), F.col("file_id")), F.when(F.col("has_art"), first)).alias("_art"),
    )
    return merged.select(
        *keys,
        *[F.col(f"_first.{c}").alias(c) for c in carry],
        *[F.col(f"_best.{c}").alias(c) for c in copy],
        "extras",
        F.col("_art").isNotNull().alias("has_art"),
        F.when(~F.col("_first_art"), F.col("_art")).alias("art_file_id"),
        "_ord",
    )


def renditions(items: DataFrame, keys: dict[str, Column], spread: bool = False) -> DataFrame:
    """Every copy with its rank within its work (1 is the primary), best first."""
    names = list(keys)
    ranked = items.select(*[c.alias(n) for n, c in keys.items()], *COPY).select(
        "*", (-pixels()).alias("_px"), (-F.col("size")).alias("_size")
    )
    ranked = ordered_columns(ranked, names, ["_px", "_size", "file_id"], spread, quality_rank=("row_number",))
    return ranked.select(*names, *COPY, "quality_rank")
