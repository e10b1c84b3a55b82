"""Agreement and similarity features of record pairs, and the candidate filter."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowkin.functions.keys import holdout_split, pair_id
from rowkin.functions.similarity import agreement, with_token_set_similarity
from rowkin.operators.blocking import MAX_BLOCK_SIZE, paired_rows, refined_blocks

# Least name similarity of a pair without a common e-mail or phone.
MIN_NAME_SIMILARITY = 0.6

COMPARED = ("email", "phone_e164", "birth_date", "city", "full_name_norm", "address")
AGREEMENTS = {"email_agree": "email", "phone_agree": "phone_e164", "birth_agree": "birth_date", "city_agree": "city"}
FEATURES = (*AGREEMENTS, "name_sim", "address_sim")
PAIR_COLUMNS = ("pair_id", "left_key", "right_key", *FEATURES, "birth_date_conflict")
MARKS = ("split", "is_match")


def attach_records(pairs: DataFrame, entities: DataFrame, fields: Iterable[str] = COMPARED) -> DataFrame:
    """Both records' fields next to each pair. A record is in few pairs, so neither join is skewed."""
    fields = list(fields)
    for name in ("left", "right"):
        named = [F.col(c).alias(f"{name}_{c}") for c in fields]
        pairs = pairs.join(entities.select(F.col("entity_key").alias(f"{name}_key"), *named), f"{name}_key")
    return pairs


def _with_similarity(records: DataFrame, name: str, field: str) -> DataFrame:
    return with_token_set_similarity(records, name, F.col(f"left_{field}"), F.col(f"right_{field}"))


def _with_agreements(records: DataFrame) -> DataFrame:
    codes = {name: agreement(F.col(f"left_{f}"), F.col(f"right_{f}")) for name, f in AGREEMENTS.items()}
    return records.withColumns(codes)


def is_candidate() -> Column:
    strong = (F.col("email_agree") == 1) | (F.col("phone_agree") == 1)
    return strong | (F.col("name_sim") >= MIN_NAME_SIMILARITY)


def _finished(records: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    return _with_similarity(records, "address_sim", "address").select(
        pair_id(F.col("left_key"), F.col("right_key")).alias("pair_id"),
        "left_key", "right_key", *FEATURES,
        (F.col("birth_agree") == -1).alias("birth_date_conflict"), *keep,
    )


def pair_features(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """All features of the given candidate pairs, unfiltered."""
    records = _with_agreements(attach_records(candidates, entities))
    return _finished(_with_similarity(records, "name_sim", "full_name_norm"))


def filtered_features(records: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Features of ``left_…``/``right_…`` records; the name is compared first, the address of the rest."""
    named = _with_similarity(_with_agreements(records), "name_sim", "full_name_norm")
    return _finished(named.where(is_candidate()), keep)


def repeats(rows: DataFrame, key: str) -> bool:
    """Whether any value of ``key`` is in several rows."""
    return not rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1").isEmpty()


def build_pairs(entities: DataFrame, max_block: int = MAX_BLOCK_SIZE, fitting: DataFrame | None = None) -> DataFrame:
    """Blocking, features and filter in one go.

    The compared fields travel with the block rows, so no pair has to look up its records again.
    A pair comes out of the first block its records share, so only records whose key is in several
    rows can give the same pair again; without these nothing is shuffled after the comparison.
    """
    found = filtered_features(paired_rows(entities, COMPARED, max_block, fitting=fitting))
    return found.distinct() if repeats(entities, "entity_key") else found


def build_marked(entities: DataFrame, truth: DataFrame, max_block: int = MAX_BLOCK_SIZE, fitting: DataFrame | None = None) -> DataFrame:
    """``marked_pairs`` of ``build_pairs``: the labels travel with the records too, so no pair is looked up for them.

    That holds where a key has one row on either side; else a pair has to become a row per label.
    """
    fitting = refined_blocks(entities, max_block)[0] if fitting is None else fitting
    if repeats(truth, "entity_key") or repeats(entities, "entity_key"):
        return marked_pairs(build_pairs(entities, max_block, fitting), truth)
    label = truth.select("entity_key", F.struct("true_entity_id", "split").alias("label"))
    labelled = entities.select("entity_key", *COMPARED).join(label, "entity_key", "left")
    marked = _with_marks(paired_rows(labelled, (*COMPARED, "label"), max_block, fitting=fitting))
    return filtered_features(marked, MARKS)


def _with_marks(pairs: DataFrame) -> DataFrame:
    known = F.col("left_label").isNotNull() & F.col("right_label").isNotNull()
    return pairs.withColumns({
        "split": F.when(known, F.col("left_label.split")),
        "is_match": F.when(known, F.col("left_label.true_entity_id") == F.col("right_label.true_entity_id")),
    }).drop("left_label", "right_label")


def marked_pairs(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """All pairs, with ``split`` and ``is_match`` where both records are labelled, else NULL.

    The left record's split counts. Models and measures use the labelled rows, decisions are for all.
    """
    person = truth.select("entity_key", "true_entity_id", "split")
    for side in ("left", "right"):
        named = person.select(F.col("entity_key").alias(f"{side}_key"), F.struct("true_entity_id", "split").alias(f"{side}_label"))
        pairs = pairs.join(named, f"{side}_key", "left")
    return _with_marks(pairs).select(*[c for c in PAIR_COLUMNS if c in pairs.columns], *MARKS)


def build_labeled(entities: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs with both records labelled."""
    return build_marked(entities, truth).where(F.col("is_match").isNotNull())


def split_assignment(persons: DataFrame) -> DataFrame:
    """dev/test split of every person in ``true_entity_id``."""
    return persons.select("true_entity_id").distinct().withColumn("split", holdout_split(F.col("true_entity_id")))
