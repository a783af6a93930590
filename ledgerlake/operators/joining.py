"""Join shapes of the loads: upsert, update-from, insert-missing, one-match lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_match(df: DataFrame, lookup: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Adds one looked-up value per key (the smallest), falling back to the key itself."""
    best = lookup.groupBy(key).agg(F.min(value).alias(out))
    return df.join(best, key, "left").withColumn(out, F.coalesce(F.col(out), F.col(key)))


def insert_missing(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Current rows plus the incoming rows whose key is not there yet."""
    fresh = incoming.join(current.select(*keys).distinct(), keys, "left_anti")
    return current.unionByName(fresh, allowMissingColumns=True)


def update_from(current: DataFrame, source: DataFrame, keys: list[str], assign: dict[str, Column],
                only: Column | None = None) -> DataFrame:
    """Overwrite columns of matched rows; a NULL in the source overwrites too.

    ``source`` has one row per key. ``assign`` maps a target column to an expression over
    ``t`` (current) and ``s`` (source); ``only`` limits which current rows may change.
    """
    t, s = current.alias("t"), source.withColumn("_hit", F.lit(True)).alias("s")
    match = F.lit(True)
    for key in keys:
        match = match & (F.col(f"t.{key}") == F.col(f"s.{key}"))
    hit = F.col("s._hit").isNotNull() if only is None else F.col("s._hit").isNotNull() & only
    return t.join(s, match, "left").select(*[
        F.when(hit, assign[c]).otherwise(F.col(f"t.{c}")).alias(c) if c in assign else F.col(f"t.{c}").alias(c)
        for c in current.columns
    ])


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update: list[str]) -> DataFrame:
    """Matched rows take ``update`` from the source, unmatched source rows are added, none is deleted."""
    t = target.withColumn("_old", F.lit(True)).alias("t")
    s = source.withColumn("_new", F.lit(True)).alias("s")
    match = F.lit(True)
    for key in keys:
        match = match & (F.col(f"t.{key}") == F.col(f"s.{key}"))

    def pick(c: str) -> Column:
        if c in keys:
            return F.coalesce(F.col(f"t.{c}"), F.col(f"s.{c}")).alias(c)
        if c not in source.columns:
            return F.col(f"t.{c}").alias(c)
        takes_new = F.col("s._new").isNotNull() if c in update else F.col("t._old").isNull()
        return F.when(takes_new, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c)

    return t.join(s, match, "full_outer").select(*[pick(c) for c in target.columns])


def merge_series(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Two daily series side by side; a missing side counts 0."""
    joined = left.join(right, key, "full_outer")
    return joined.select(key, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in joined.columns if c != key])


def contained_codes(classes: DataFrame, products: DataFrame) -> DataFrame:
    """Pairs (GL_CLASS_CODE, PROD_CODE) where the class text contains the product code, ignoring case.

    Works on distinct codes: a class gives its pieces of the lengths that product codes have, and those are
    equality keys. So a class of L characters gives at most L pieces for each length that occurs, no pair is formed that does
    not match, and one busy branch or day cannot gather all pairs. An empty code is contained in every class.
    """
    c = classes.select("GL_CLASS_CODE").filter("GL_CLASS_CODE IS NOT NULL").distinct()
    p = products.select("PROD_CODE").filter("PROD_CODE IS NOT NULL").distinct().withColumn("_key", F.upper("PROD_CODE"))
    lengths = p.agg(F.collect_set(F.length("_key"))).scalar()
    long_enough = c.withColumn("_upper", F.upper("GL_CLASS_CODE")).withColumn("_size", F.explode(lengths)).filter("_size <= length(_upper)")
    first = F.when(F.col("_size") == 0, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.length("_upper") - F.col("_size") + 1))
    pieces = long_enough.withColumn("_from", F.explode(first)).select("GL_CLASS_CODE", F.substring("_upper", F.col("_from"), F.col("_size")).alias("_key")).distinct()
    return pieces.join(p, "_key").select("GL_CLASS_CODE", "PROD_CODE")
