"""SQL names for the seven cleansing rules, as temporary SQL functions (no Python UDF)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import cleanse

SQL_NAMES = {
    "clean_customer_id": ("STRING", cleanse.CUSTOMER_ID),
    "clean_account_no": ("STRING", cleanse.ACCOUNT_NO),
    "clean_branch_code": ("STRING", cleanse.BRANCH_CODE),
    "clean_amount": ("DECIMAL(18,2)", cleanse.AMOUNT),
    "clean_date": ("DATE", cleanse.DATE),
    "clean_asset_class": ("STRING", cleanse.ASSET_CLASS),
    "clean_account_status": ("STRING", cleanse.ACCOUNT_STATUS),
}


def register(spark: SparkSession) -> None:
    for name, (kind, body) in SQL_NAMES.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(raw STRING) RETURNS {kind} "
            f"RETURN {body.format(x='raw')}"
        )
