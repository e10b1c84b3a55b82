"""Second scores for the review queue: batches, record texts, and pluggable scorers."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowkin.operators.pairs import attach_records
from rowkin.session import stage
from rowkin.sources.tables import Layers

# What a scorer may see of a record, and under which name; never an id.
SCORED_FIELDS = {
    "full_name_norm": "name", "email": "email", "phone_e164": "phone",
    "birth_date": "birth", "city": "city", "address": "address",
}
BATCH_SIZE = 250
BATCH_DIGITS = 3
_BUCKET_CHARS = 4  # pair ids are hexadecimal hashes: 65,536 even buckets, whatever the data


def record_text(side: str) -> Column:
    parts = [
        F.concat(F.lit(f"{label}="), F.coalesce(F.col(f"{side}_{field}").cast("string"), F.lit("")))
        for field, label in SCORED_FIELDS.items()
    ]
    return F.concat_ws("; ", *parts)


def valid_score(raw: Column) -> Column:
    """A number in [0, 1]; anything else is NULL."""
    number = raw.try_cast("double")
    return F.when(~F.isnan(number) & number.between(0.0, 1.0), number)


def plan_batches(queue: DataFrame, batch_size: int = BATCH_SIZE) -> DataFrame:
    """(pair_id, batch_id): consecutive batches in the order of ``pair_id``.

    The running number is the rank inside a bucket of the id's leading digits plus the size of
    all buckets before it. Only the list of bucket sizes, at most 65,536 rows, is ever in one task.
    """
    bucketed = queue.select("pair_id", F.substring("pair_id", 1, _BUCKET_CHARS).alias("bucket"))
    sizes = bucketed.groupBy("bucket").agg(F.count("*").alias("rows"))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("pair_id"))
    numbered = bucketed.withColumn("rank", rank).join(F.broadcast(offsets), "bucket")
    number = F.floor((F.col("rank") + F.col("offset") - 1) / batch_size).cast("string")
    width = F.greatest(F.length(number), F.lit(BATCH_DIGITS))
    return numbered.select("pair_id", F.concat(F.lit("b"), F.lpad(number, width, F.lit("0"))).alias("batch_id"))


def scoring_input(queue: DataFrame, entities: DataFrame) -> DataFrame:
    """(pair_id, batch_id, record_a, record_b)."""
    records = attach_records(queue.select("pair_id", "batch_id", "left_key", "right_key"), entities, SCORED_FIELDS)
    return records.select("pair_id", "batch_id", record_text("left").alias("record_a"), record_text("right").alias("record_b"))


@dataclass(frozen=True)
class BatchScorer:
    """A model: ``load`` runs once per Python worker and returns a function of two text lists."""

    name: str
    load: Callable[[], Callable[[Sequence[str], Sequence[str]], Sequence[object]]]
    key: str = field(default_factory=lambda: uuid.uuid4().hex)  # what workers keep the loaded model under


@dataclass(frozen=True)
class ColumnScorer:
    """A score that is a plain column expression of the two record texts."""

    name: str
    expression: Callable[[Column, Column], Column]


_LOADED: dict[str, Callable] = {}

SCORED_SCHEMA = "pair_id string, batch_id string, raw string, load_s double, infer_s double, error string"


def _score_batch(scorer: BatchScorer, batch: pd.DataFrame) -> pd.DataFrame:
    """Score one batch; a failed or short answer leaves every score of the batch empty and says why."""
    start = time.perf_counter()
    answers: Sequence[object] = []
    loaded, error = start, None
    try:
        if scorer.key not in _LOADED:
            _LOADED[scorer.key] = scorer.load()
        loaded = time.perf_counter()
        answers = list(_LOADED[scorer.key](batch["record_a"].tolist(), batch["record_b"].tolist()))
    except Exception as failure:  # a scorer's error must never decide a pair
        answers, error = [], f"{type(failure).__name__}: {failure}"
    done = time.perf_counter()
    if len(answers) != len(batch):
        error = error or f"{len(answers)} answers for {len(batch)} pairs"
        answers = [None] * len(batch)
    raw = [str(a) if isinstance(a, (int, float, str)) and not isinstance(a, bool) else None for a in answers]
    return pd.DataFrame({
        "pair_id": batch["pair_id"], "batch_id": batch["batch_id"], "raw": raw,
        "load_s": loaded - start, "infer_s": done - loaded, "error": error,
    })


def score_queue(texts: DataFrame, scorer: BatchScorer | ColumnScorer) -> DataFrame:
    """(pair_id, batch_id, checkpoint, p_same, load_s, infer_s, error) of every pair in ``texts``.

    Batches are the groups, so no task holds more than one batch. Write the result once: reading
    it twice would run the model twice.
    """
    if isinstance(scorer, ColumnScorer):
        raw = scorer.expression(F.col("record_a"), F.col("record_b"))
        scored = texts.select("pair_id", "batch_id", raw.alias("raw"),
                              F.lit(0.0).alias("load_s"), F.lit(0.0).alias("infer_s"), F.lit(None).cast("string").alias("error"))
    else:
        def run(batch: pd.DataFrame) -> pd.DataFrame:
            return _score_batch(scorer, batch)

        scored = texts.groupBy("batch_id").applyInPandas(run, SCORED_SCHEMA)
    return scored.select("pair_id", "batch_id", F.lit(scorer.name).alias("checkpoint"),
                         valid_score(F.col("raw")).alias("p_same"), "load_s", "infer_s", "error")


def _inputs(texts: DataFrame) -> DataFrame:
    """``texts`` with a hash of what the scorer sees, so that a score of other texts is no score of these."""
    return texts.withColumn("input", F.xxhash64("record_a", "record_b"))


def missing_scores(texts: DataFrame, stored: DataFrame | None, checkpoint: str) -> DataFrame:
    """The rows of ``texts`` that have no answer of this scorer to these texts; failed ones are missing too."""
    if stored is None:
        return texts
    answered = stored.where((F.col("checkpoint") == checkpoint) & F.col("error").isNull()).select("pair_id", "input")
    return _inputs(texts).join(answered, ["pair_id", "input"], "left_anti").select(*texts.columns)


def resume_scores(texts: DataFrame, scorer: BatchScorer | ColumnScorer, layers: Layers, table: str = "score_log",
                  wave: int = 4_096) -> DataFrame:
    """Like ``score_queue``, but batches that an earlier, stopped call wrote are not scored again.

    Batches are scored in waves of ``wave`` batches, one job each, and a wave's scores are appended
    to ``ops/<table>`` when it ends. A later call scores only pairs without an answer (batches
    that failed, pairs that are new or whose texts changed). The result has one row for each pair
    of ``texts``: its answer if there is one, else its last failure. A scorer is known by its
    name, so a new model needs a new name.
    """
    texts = stage(texts, "texts")
    stored = layers.read_or_none("ops", table)
    attempt = 1 if stored is None else (stored.agg(F.max("attempt").alias("n")).first()["n"] or 0) + 1
    todo = missing_scores(texts, stored, scorer.name)
    number = F.substring("batch_id", 2, 20).try_cast("bigint")  # a letter and a running number; other ids form one wave
    todo = stage(todo.withColumn("wave", F.floor(F.coalesce(number, F.lit(0)) / wave)), "todo")
    for row in todo.select("wave").distinct().orderBy("wave").collect():
        part = todo.where(F.col("wave") == row["wave"]).drop("wave")
        scored = score_queue(part, scorer).join(_inputs(part).select("pair_id", "input"), "pair_id")
        scored.withColumn("attempt", F.lit(attempt).cast("bigint")).write.mode("append").parquet(layers.path("ops", table))

    stored = layers.read_or_none("ops", table)
    if stored is None:
        return score_queue(texts, scorer)  # an empty queue
    own = stored.where(F.col("checkpoint") == scorer.name)
    best = F.max_by(F.struct("p_same", "load_s", "infer_s", "error"), F.struct(F.col("error").isNull(), "attempt"))
    answers = own.groupBy("pair_id", "input").agg(best.alias("best"))
    rows = _inputs(texts).select("pair_id", "batch_id", "input").join(answers, ["pair_id", "input"])
    return rows.select("pair_id", "batch_id", F.lit(scorer.name).alias("checkpoint"), "best.*")


class ScorerFailed(RuntimeError):
    """Every batch of a scorer failed."""


def failed_batches(scored: DataFrame) -> DataFrame:
    """(checkpoint, batch_id, pairs, error) of the batches that have no scores."""
    return scored.where(F.col("error").isNotNull()).groupBy("checkpoint", "batch_id").agg(
        F.count("*").alias("pairs"), F.min("error").alias("error"))


def require_some(scored: DataFrame) -> None:
    """Raise when there are pairs and every batch of them failed; single failed batches stay in REVIEW."""
    seen = scored.agg(F.count("*").alias("pairs"), F.count("error").alias("failed"), F.min("error").alias("error")).first()
    if seen["pairs"] and seen["failed"] == seen["pairs"]:
        raise ScorerFailed(seen["error"])


def batch_timing(scored: DataFrame, run_id: str) -> DataFrame:
    return scored.groupBy("batch_id", "checkpoint").agg(
        F.count("*").cast("int").alias("pairs"), F.max("load_s").alias("load_s"), F.max("infer_s").alias("infer_s")
    ).select(F.lit(run_id).alias("run_id"), "batch_id", "checkpoint", "pairs", "load_s", "infer_s")


def token_overlap(a: Column, b: Column) -> Column:
    """Share of common words among all words of two texts."""
    words_a, words_b = F.array_distinct(F.split(a, "[ ;]+")), F.array_distinct(F.split(b, "[ ;]+"))
    union = F.size(F.array_union(words_a, words_b))
    return F.size(F.array_intersect(words_a, words_b)) / F.greatest(union, F.lit(1))


def review_queue(decided_pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """Pairs a person has to look at, with both records as JSON (missing values kept)."""
    as_json = F.to_json(F.struct(*entities.columns), {"ignoreNullFields": "false"})
    pairs = decided_pairs.where(F.col("decision") == "REVIEW")
    for side in ("left", "right"):
        record = entities.select(F.col("entity_key").alias(f"{side}_key"), as_json.alias(f"{side}_record"))
        pairs = pairs.join(record, f"{side}_key")
    return pairs.select("pair_id", "p_match", "birth_date_conflict", "left_record", "right_record")
