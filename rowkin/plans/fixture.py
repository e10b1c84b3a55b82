"""CRM rows, billing rows and ground truth for the registered queries.

The given tables hold no data of two customer systems, so rows of both are derived from ``customer``
and ``nation`` by one SQL text (fixture.sql), which DuckDB runs as well. Nothing outside the
registered queries and the tests uses this.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowkin.functions.keys import holdout_split

with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixture.sql"), encoding="utf-8") as _f:
    ROWS_SQL = "".join(line for line in _f if not line.lstrip().startswith("--")).strip()


def source_rows(customer: DataFrame, nation: DataFrame) -> DataFrame:
    """All rows of both systems in one table, with ``src`` and the true ``person_id``."""
    text = "WITH " + ROWS_SQL.replace("FROM customer JOIN nation", "FROM {customer} JOIN {nation}")
    columns = "src, id, person_id, given, family, email, phone, birth, address, city, r_case, updated_at"
    return customer.sparkSession.sql(f"{text} SELECT {columns} FROM w", customer=customer, nation=nation)


def crm_users(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("src") == "crm").selectExpr(
        "id AS crm_id", "given AS first_name", "family AS last_name", "email", "phone", "birth AS birth_date", "address", "city", "updated_at")


def billing_users(rows: DataFrame) -> DataFrame:
    full_name = "CASE WHEN r_case % 2 = 0 THEN concat(family, ', ', given) ELSE concat(given, ' ', family) END AS full_name"
    return rows.where(F.col("src") == "billing").selectExpr(
        "id AS billing_id", full_name, "email", "phone", "address AS billing_address", "city", "updated_at")


def ground_truth(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat_ws(":", "src", "id").alias("entity_key"), F.col("person_id").alias("true_entity_id"),
                       holdout_split(F.col("person_id")).alias("split"))
