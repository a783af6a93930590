"""Branch hierarchy: office codes, upsert, listings and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cleanse
from ..operators import joining, scope
from .schemas import BRANCH_HIERARCHY, conform

HEAD_OFFICE_CODE = "00001"
UNASSIGNED, UNKNOWN_DISTRICT = "Unassigned", "Unknown"


def office_codes(network: DataFrame) -> DataFrame:
    """(REGIONAL_OFFICE, RO_CODE): head office first, unassigned last, else by name.

    The unpartitioned number runs over the distinct office names, about a dozen.
    """
    office = F.coalesce("REGIONAL_OFFICE", F.lit(UNASSIGNED))
    names = network.select(office.alias("REGIONAL_OFFICE")).distinct()
    place = F.when(F.upper("REGIONAL_OFFICE") == "HEAD OFFICE", 0).when(F.upper("REGIONAL_OFFICE") == "UNASSIGNED", 999).otherwise(1)
    number = F.row_number().over(Window.orderBy(place, "REGIONAL_OFFICE"))
    # Two digits at least: a cut code would give two offices, and the users who may see them, one code.
    digits = number.cast("string")
    padded = F.lpad(digits, F.greatest(F.length(digits), F.lit(2)), F.lit("0"))
    return names.select("REGIONAL_OFFICE", F.concat(F.lit("RO"), padded).alias("RO_CODE"))


def branch_rows(network: DataFrame) -> DataFrame:
    """The network as dimension rows."""
    rows = network.filter(scope.key_present("BRANCH_CODE")).withColumn(
        "REGIONAL_OFFICE", F.coalesce("REGIONAL_OFFICE", F.lit(UNASSIGNED)))
    rows = rows.join(office_codes(network), "REGIONAL_OFFICE", "left")
    return conform(rows.select(
        cleanse.branch_code("BRANCH_CODE").alias("BRANCH_CODE"), cleanse.trimmed("BRANCH_NAME").alias("BRANCH_NAME"),
        F.col("RO_CODE").alias("REGIONAL_OFFICE_CODE"), F.col("REGIONAL_OFFICE").alias("REGIONAL_OFFICE_NAME"),
        F.lit(HEAD_OFFICE_CODE).alias("HEAD_OFFICE_CODE"), F.coalesce("DISTRICT", F.lit(UNKNOWN_DISTRICT)).alias("DISTRICT"),
        "ADDRESS", F.lit(True).alias("IS_ACTIVE"),
    ), BRANCH_HIERARCHY)


def load_hierarchy(network: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Upsert: known branches are refreshed but keep IS_ACTIVE, new ones are added, none is removed."""
    rows = branch_rows(network)
    if current is None:
        return rows
    update = [c for c in BRANCH_HIERARCHY if c not in ("BRANCH_CODE", "IS_ACTIVE")]
    return joining.upsert(current.select(*BRANCH_HIERARCHY), rows, ["BRANCH_CODE"], update)


def branches_per_office(hierarchy: DataFrame) -> DataFrame:
    return hierarchy.groupBy("REGIONAL_OFFICE_CODE", "REGIONAL_OFFICE_NAME").agg(
        F.count("*").alias("BRANCH_COUNT")).orderBy("REGIONAL_OFFICE_CODE", "REGIONAL_OFFICE_NAME")


def regions(network: DataFrame) -> DataFrame:
    return network.select(F.col("REGIONAL_OFFICE").alias("region")).filter("region IS NOT NULL").distinct()


def branch_list(network: DataFrame) -> DataFrame:
    rows = network.filter(F.col("BRANCH_CODE") != "").select("BRANCH_CODE", "BRANCH_NAME", "REGIONAL_OFFICE").distinct()
    return rows.select(
        F.trim("BRANCH_CODE").alias("code"), F.coalesce(F.nullif(F.trim("BRANCH_NAME"), F.lit("")), F.lit("Unknown")).alias("name"),
        F.coalesce(F.trim("REGIONAL_OFFICE"), F.lit("")).alias("region"),
    ).orderBy("code", "name")


def visible_branches(network: DataFrame, hierarchy: DataFrame, access: DataFrame, user: str | None) -> DataFrame:
    """The branch list under row-level security."""
    from ..operators.security import secure

    return branch_list(network.join(secure(hierarchy, access, hierarchy, user).select("BRANCH_CODE"), "BRANCH_CODE", "left_semi"))


def network_listing(network: DataFrame, branch: str = "ALL") -> DataFrame:
    rows = scope.in_branch(network, branch, network)
    return rows.select(
        "HEAD_OFFICE", "REGIONAL_OFFICE", "BRANCH_NAME", "DISTRICT", "ADDRESS", "CONTACT_NO"
    ).orderBy(F.asc_nulls_first("REGIONAL_OFFICE"), "BRANCH_NAME")


def office_order(office: Column) -> Column:
    """Head Office first, Rail Head Complex second, the rest by name."""
    name = F.lower(office)
    return F.when(name == "head office", 0).when(name == "rail head complex", 1).otherwise(2)


def directory(network: DataFrame, text: str = "") -> DataFrame:
    """Branches whose own or office name contains the text, grouped by office in display order."""
    rows = scope.search(network, text, ["BRANCH_NAME", "REGIONAL_OFFICE"])
    office = F.coalesce("REGIONAL_OFFICE", F.lit(UNASSIGNED))
    return rows.select(office.alias("office"), "BRANCH_NAME", "BRANCH_CODE", "DISTRICT").orderBy(
        office_order(F.col("office")), "office", "BRANCH_NAME", "BRANCH_CODE")
