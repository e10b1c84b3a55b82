"""One golden record per cluster: per field, the most recent value that is present."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The surviving fields of a golden record.
SURVIVING = ("given_name", "family_name", "email", "phone_e164", "birth_date", "city", "address")
MASTER_COLUMNS = ("master_id", *SURVIVING, "source_count", "has_pending_review")


def latest_present(field: str, updated_at: str, tie: str) -> Column:
    """Aggregate: ``field`` of the latest row where it is present; undated rows last, ties by ``tie``.

    An ordinary aggregate instead of a sorted window: it combines before the shuffle, so a cluster
    with very many records never comes together in one task.
    """
    micros = F.unix_micros(F.col(updated_at).cast("timestamp"))
    recency = F.struct(F.col(updated_at).isNull(), -F.coalesce(micros, F.lit(0)), F.col(tie))
    return F.min_by(field, F.when(F.col(field).isNotNull(), recency)).alias(field)


def pending_entities(decisions: DataFrame) -> DataFrame:
    """Distinct entities of REVIEW pairs."""
    ends = F.explode(F.array("left_key", "right_key")).alias("entity_key")
    return decisions.where(F.col("decision") == "REVIEW").select(ends).distinct()


def golden_records(entities: DataFrame, xref: DataFrame, review: DataFrame) -> DataFrame:
    """``xref`` maps every entity to its ``master_id``; ``review`` lists the entities in review."""
    flagged = review.select("entity_key", F.lit(True).alias("in_review"))
    rows = entities.join(xref, "entity_key").join(flagged, "entity_key", "left")
    return rows.groupBy("master_id").agg(
        *[latest_present(field, "updated_at", "entity_key") for field in SURVIVING],
        F.count("*").cast("int").alias("source_count"),
        F.bool_or(F.coalesce("in_review", F.lit(False))).alias("has_pending_review"),
    )
