"""Source rows of each system in the one shared entity schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowkin.functions import contact, keys, text

ENTITY_COLUMNS = (
    "entity_key", "source", "source_id", "given_name", "family_name", "full_name_norm", "family_soundex",
    "email", "phone_e164", "birth_date", "city", "address", "updated_at",
)


def _entities(rows: DataFrame, source: str, id_column: str) -> DataFrame:
    """Narrow projections only: no shuffle, no Python worker."""
    normed = rows.withColumns({
        f"{name}_norm": text.norm_text(name) for name in ("given", "family", "city", "address")
    })
    return normed.select(
        keys.entity_key(source, F.col(id_column)).alias("entity_key"),
        F.lit(source).alias("source"),
        F.col(id_column).alias("source_id"),
        text.display_name(F.col("given")).alias("given_name"),
        text.display_name(F.col("family")).alias("family_name"),
        text.blank_to_null(F.concat_ws(" ", "given_norm", "family_norm")).alias("full_name_norm"),
        keys.family_key(F.col("family_norm")).alias("family_soundex"),
        contact.norm_email(F.col("email")).alias("email"),
        contact.norm_phone(F.col("phone")).alias("phone_e164"),
        contact.norm_date(F.col("birth_date")).alias("birth_date"),
        F.col("city_norm").alias("city"),
        contact.norm_address(F.col("address_norm")).alias("address"),
        contact.to_instant(F.col("updated_at")).alias("updated_at"),
    )


def crm_entities(crm: DataFrame) -> DataFrame:
    return _entities(crm.withColumnsRenamed({"first_name": "given", "last_name": "family"}), "crm", "crm_id")


def billing_entities(billing: DataFrame) -> DataFrame:
    """Billing keeps the name in one field and knows no birth date."""
    rows = billing.withColumnsRenamed({"billing_address": "address"}).withColumns({
        "given": text.given_of(F.col("full_name")),
        "family": text.family_of(F.col("full_name")),
        "birth_date": F.lit(None).cast("string"),
    })
    return _entities(rows, "billing", "billing_id")


def all_entities(crm: DataFrame, billing: DataFrame) -> DataFrame:
    return crm_entities(crm).unionByName(billing_entities(billing))
