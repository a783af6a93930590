"""Top-k, bottom-k, per-group ranks, shares and the latest row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: Column, tiebreak: list[str], k: int) -> DataFrame:
    return df.orderBy(by, *tiebreak).limit(k)


def top_per_group(df: DataFrame, group: list[str], by: Column, tiebreak: list[str], k: int,
                  rank: str = "RNK") -> DataFrame:
    """k best rows per group; the rank filter is applied before the shuffle as well (group limit)."""
    w = Window.partitionBy(*group).orderBy(by, *tiebreak)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def top_and_bottom(df: DataFrame, measure: str, n: int, high: str = "TOP", low: str = "BOTTOM") -> DataFrame:
    """Rank rows by a measure and keep both ends, ties included.

    ``df`` holds one row per branch, so the unpartitioned rank runs over branches, not facts.
    """
    ranked = (
        df.withColumn("RANK_TOP", F.rank().over(Window.orderBy(F.desc(measure))))
        .withColumn("_up", F.rank().over(Window.orderBy(F.asc(measure))))
    )
    return (
        ranked.filter((F.col("RANK_TOP") <= n) | (F.col("_up") <= n))
        .withColumn("RANKING_CATEGORY", F.when(F.col("RANK_TOP") <= n, high).otherwise(low)).drop("_up")
    )


def both_ends(df: DataFrame, by: str, tiebreak: list[str], k: int) -> DataFrame:
    """Leaderboard: k best and k worst rows as two bounded sorts."""
    best = df.orderBy(F.desc(by), *tiebreak).limit(k).withColumn("board", F.lit("TOP"))
    worst = df.orderBy(F.asc(by), *tiebreak).limit(k).withColumn("board", F.lit("BOTTOM"))
    return best.unionByName(worst)


def latest_row(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """Newest row per key by a declared order; all but one row a key and task go before the shuffle (group limit). A NULL in
    the order is oldest."""
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order]))
    return df.select(*keys, *[c for c in keep if c not in keys], *[c for c in order if c not in (*keys, *keep)]).withColumn("_nth", newest).filter("_nth = 1").select(*keys, *keep)


def with_share(df: DataFrame, measure: str, out: str = "share", digits: int = 2) -> DataFrame:
    """Percent of the frame's total; 0 when the total is not positive."""
    total = df.agg(F.sum(measure)).scalar()
    return df.withColumn(out, F.round(F.when(total > 0, F.col(measure) / total * 100).otherwise(F.lit(0.0)), digits))


def top_with_others(df: DataFrame, name: str, measure: str, k: int, by_magnitude: bool = False,
                    positive_only: bool = False, spare: int = 0, label: str = "Others") -> DataFrame:
    """k largest names plus one row with the rest.

    ``by_magnitude`` orders by absolute value; ``positive_only`` shows the rest only above 0; with
    ``spare`` up to k + spare names are shown as they are.
    """
    rows = df.groupBy(name).agg(F.sum(measure).alias(measure))
    weight = F.abs(measure) if by_magnitude else F.col(measure)
    best = rows.orderBy(weight.desc(), name).limit(k + spare)
    if spare:
        # At most k + spare rows reach this window.
        place = F.row_number().over(Window.orderBy(weight.desc(), name))
        crowded = rows.agg(F.count("*")).scalar() > k + spare
        best = best.withColumn("_place", place).filter((F.col("_place") <= k) | ~crowded).drop("_place")
    rest = rows.join(best.select(name), name, "left_anti").agg(F.sum(measure).alias(measure), F.count("*").alias("_n"))
    rest = rest.filter(F.col(measure) > 0) if positive_only else rest.filter("_n > 0")
    return best.unionByName(rest.select(F.lit(label).alias(name), measure))
