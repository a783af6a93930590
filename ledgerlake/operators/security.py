"""Row-level branch security as a semi join; roles of one user are OR-ed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def allowed_branches(access: DataFrame, branches: DataFrame, user: str) -> DataFrame:
    """Branch codes that a user may read through an active HO, RO or BRANCH role."""
    mine = access.filter((F.col("USER_LOGIN") == user) & F.col("IS_ACTIVE"))
    own = mine.filter(F.col("ACCESS_ROLE") == "BRANCH").select("BRANCH_CODE")
    office = branches.join(
        mine.filter(F.col("ACCESS_ROLE") == "RO").select("REGIONAL_OFFICE_CODE"), "REGIONAL_OFFICE_CODE", "left_semi"
    ).select("BRANCH_CODE")
    return own.union(office).distinct()


def secure(df: DataFrame, access: DataFrame, branches: DataFrame, user: str | None) -> DataFrame:
    """No user: all rows. HO: all rows. Otherwise the user's branches; unknown users see nothing."""
    if user is None:
        return df
    head_office = access.filter(
        (F.col("USER_LOGIN") == user) & F.col("IS_ACTIVE") & (F.col("ACCESS_ROLE") == "HO")
    ).agg(F.count("*")).scalar() > 0
    visible = allowed_branches(access, branches, user).select("BRANCH_CODE", F.lit(True).alias("_mine"))
    return df.join(visible, "BRANCH_CODE", "left").filter(F.col("_mine") | head_office).drop("_mine")
