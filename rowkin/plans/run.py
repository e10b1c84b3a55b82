"""One full linkage run: sources in, published golden records and a report out."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowkin.operators import cascade, decide, metrics, quality, scoring
from rowkin.operators.components import clusters, cross_reference
from rowkin.operators.digest import combined_digest
from rowkin.operators.entities import ENTITY_COLUMNS, all_entities
from rowkin.operators.golden import MASTER_COLUMNS, golden_records, pending_entities
from rowkin.operators.blocking import MAX_BLOCK_SIZE, refined_blocks
from rowkin.operators.pairs import PAIR_COLUMNS, build_marked, repeats
from rowkin.operators.upsert import overlay, upsert
from rowkin.session import stage
from rowkin.sources.tables import Layers, VersionedTables

RULES = "rules"
BASELINE = "baseline"
TIME_ZONE = "spark.sql.session.timeZone"
GOLD_TABLES = ["customer_master", "customer_xref"]


@dataclass(frozen=True)
class RunConfig:
    """Parameters of a run. ``primary`` names the scorer whose cascade feeds gold, or "baseline"."""

    scorers: Sequence[scoring.BatchScorer | scoring.ColumnScorer] = ()
    primary: str = BASELINE
    batch_size: int = scoring.BATCH_SIZE
    target_precision: float = decide.TARGET_PRECISION
    cost_per_hour: float = 0.30
    max_block: int = MAX_BLOCK_SIZE  # larger blocks are split by further keys
    resume: bool = False  # use answers that stopped or earlier runs in this folder got from scorers of these names
    inject_duplicate: bool = False  # gate drill: a duplicated master must keep gold unchanged
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)  # may be used again: a retry is an attempt of its own

    def attempt(self) -> str:
        return f"{self.run_id}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class RunResult:
    run_id: str
    thresholds: dict[str, decide.Thresholds | None]
    report: dict[str, DataFrame]
    gold_digest: str
    same_as_previous: bool | None
    seconds: float


def config_name(scorer: str) -> str:
    return RULES if scorer == BASELINE else f"{RULES}+score_{scorer}"


def score_review(rules: DataFrame, entities: DataFrame, scorer: scoring.BatchScorer | scoring.ColumnScorer,
                 batch_size: int, layers: Layers | None = None) -> DataFrame:
    """Second scores of the REVIEW pairs, written once. Only the queue ever reaches the scorer.

    With ``layers``, answers that an earlier run wrote there are used again.
    """
    queue = rules.where(F.col("decision") == "REVIEW")
    batched = queue.join(scoring.plan_batches(queue, batch_size), "pair_id")
    texts = scoring.scoring_input(batched, entities)
    scored = stage(scoring.resume_scores(texts, scorer, layers) if layers else scoring.score_queue(texts, scorer), "scores")
    scoring.require_some(scored)
    return scored


def build_gold(entities: DataFrame, decided_pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(master, xref) from pairs with their final decision."""
    edges = decided_pairs.where(F.col("decision") == "MATCH").select("left_key", "right_key")
    xref = stage(cross_reference(clusters(entities, edges)), "xref")
    master = golden_records(entities, xref, pending_entities(decided_pairs))
    return master.select(*MASTER_COLUMNS), xref


def _tagged(df: DataFrame, **values: str) -> DataFrame:
    return df.select(*[F.lit(v).alias(k) for k, v in values.items()], *df.columns)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class Linked:
    """Everything a run computed before the gate; ``master`` and ``xref`` are written, not published."""

    attempt: str
    entities: DataFrame
    pairs: DataFrame
    labeled: DataFrame
    truth: DataFrame
    decisions: dict[str, DataFrame]
    scores: dict[str, DataFrame]
    thresholds: dict[str, decide.Thresholds | None]
    master: DataFrame
    xref: DataFrame


def entity_contracts(entities: DataFrame) -> DataFrame:
    """What every run promises about its entities."""
    return quality.contract_checks("entities", entities, quality.Contract(
        columns=ENTITY_COLUMNS, types={"birth_date": "date", "updated_at": "timestamp"}, required=("entity_key", "source", "source_id"),
        keys=(("entity_key",),), allowed={"source": ("crm", "billing")}))


def pair_contracts(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """What every run promises about its decided pairs: every pair has a decision."""
    return quality.contract_checks("pairs", pairs, quality.Contract(
        columns=(*PAIR_COLUMNS, "p_match", "decision", "batch_id"), types={"p_match": "double", "decision": "string"},
        required=("pair_id", "left_key", "right_key", "p_match", "decision"), keys=(("pair_id",), ("left_key", "right_key")),
        allowed={"decision": ("MATCH", "NON_MATCH", "REVIEW")}, ranges={"p_match": (0, 1), "name_sim": (0, 1), "address_sim": (0, 1)},
        references={"left_key": (entities, "entity_key"), "right_key": (entities, "entity_key")}))


def link(spark: SparkSession, crm: DataFrame, billing: DataFrame, truth: DataFrame, root: str,
         config: RunConfig) -> Linked:
    """Sources to staged golden records. Full refresh: each layer is written before the next reads it."""
    layers = Layers(spark, root)
    crm = layers.replace("bronze", "crm_users", crm)
    billing = layers.replace("bronze", "billing_users", billing)
    truth = layers.replace("ops", "ground_truth", truth)
    entities = layers.replace("silver", "entities", all_entities(crm, billing))
    quality.require(entity_contracts(entities))
    fitting, missed = refined_blocks(entities, config.max_block)
    marked = layers.replace("silver", "marked_pairs", build_marked(entities, truth, config.max_block, fitting))
    unmarked = marked.select(*PAIR_COLUMNS)
    features = layers.replace("silver", "pair_features", unmarked.distinct() if repeats(truth, "entity_key") else unmarked)
    layers.replace("ops", "oversized_blocks", missed)
    labeled = marked.where(F.col("is_match").isNotNull())

    # Stage 1: rules on all pairs, fitted and tuned on labelled ones. Model and thresholds are
    # numbers by now, so the decisions are a narrow projection of the pairs, cheap to repeat.
    rules, tau = decide.run_config(marked, None, config.target_precision)
    decisions, thresholds = {RULES: rules}, {RULES: tau}

    # Stage 2: each scorer on the rules' REVIEW pairs only.
    scores: dict[str, DataFrame] = {}
    batch_ids = features.limit(0).select("pair_id", F.lit("").alias("batch_id"))
    for scorer in config.scorers:
        name = config_name(scorer.name)
        scores[scorer.name] = score_review(rules, entities, scorer, config.batch_size, layers if config.resume else None)
        decisions[name], thresholds[name] = cascade.run_cascade(rules, scores[scorer.name], config.target_precision)
        batch_ids = scores[scorer.name].select("pair_id", "batch_id")  # the same for every scorer
    if scores:
        scored = _union(list(scores.values()))
        layers.replace("silver", "scores", scored.select("pair_id", "batch_id", "checkpoint", "p_same"))

    columns = ("pair_id", "p_match", "decision")
    layers.replace("silver", "pair_decisions",
                   _union([_tagged(d.select(*columns), config=name) for name, d in decisions.items()]), ("config",))
    undecided = features.withColumns({"p_match": F.lit(None).cast("double"), "decision": F.lit(None).cast("string")})
    primary = decisions.get(config_name(config.primary), rules)
    written = overlay(undecided, primary, "pair_id", columns[1:]).join(batch_ids, "pair_id", "left")
    pairs = layers.replace("silver", "pairs", written)
    quality.require(pair_contracts(pairs, entities))

    master, xref = build_gold(entities, pairs)
    if config.inject_duplicate:
        master = master.unionByName(master.limit(1))
    gold = VersionedTables(spark, os.path.join(root, "gold"))
    attempt = config.attempt()
    master = gold.write(attempt, "customer_master", master)
    xref = gold.write(attempt, "customer_xref", xref)
    return Linked(attempt, entities, pairs, labeled, truth, decisions, scores, thresholds, master, xref)


def run(spark: SparkSession, crm: DataFrame, billing: DataFrame, truth: DataFrame, root: str,
        config: RunConfig | None = None) -> RunResult:
    """Link, audit, publish, report. When a check fails, ``GateFailed`` is raised and gold is as before."""
    config = config or RunConfig()
    zone = spark.conf.get(TIME_ZONE)
    spark.conf.set(TIME_ZONE, "UTC")  # times without a zone are read as UTC
    try:
        return _run(spark, crm, billing, truth, root, config)
    finally:
        spark.conf.set(TIME_ZONE, zone)


def _run(spark: SparkSession, crm: DataFrame, billing: DataFrame, truth: DataFrame, root: str, config: RunConfig) -> RunResult:
    started = time.perf_counter()
    gold, layers = VersionedTables(spark, os.path.join(root, "gold")), Layers(spark, root)
    base = gold.last_seq()
    linked = link(spark, crm, billing, truth, root, config)
    checked = linked.master, linked.xref, linked.entities
    quality.require(quality.gold_checks(*checked), lambda: _write_offenders(layers, linked.attempt, quality.gold_offenders(*checked)))
    gold.publish(linked.attempt, GOLD_TABLES, base + 1)

    timing = _record_timing(spark, root, config.run_id, linked.attempt, linked.scores)
    digest = combined_digest([linked.master, linked.xref])
    history = layers.read_or_none("ops", "run_metrics")
    same = None if history is None else same_digest_as_last(history, digest).first()["identical"]
    report = _report(root, config, linked, timing)
    seconds = time.perf_counter() - started
    report["thresholds"] = spark.createDataFrame(
        [(name, tau.tau_high if tau else None, tau.tau_low if tau else None) for name, tau in linked.thresholds.items()],
        "config string, tau_high double, tau_low double").coalesce(1)
    report["run"] = spark.createDataFrame([(config.run_id, seconds, digest, same)], "run_id string, seconds double, gold_hash string, identical boolean").coalesce(1)
    stamp = [F.lit(config.run_id).alias("run_id"), F.lit(None).cast("double").alias("value"),
             F.current_timestamp().alias("created_at")]
    rows = [spark.range(1, numPartitions=1).select(
        *stamp, F.lit("gold_hash").alias("metric"), F.to_json(F.struct(F.lit(digest).alias("hash"))).alias("dims"))]
    for name, table in report.items():
        table.write.mode("overwrite").json(os.path.join(root, "reports", config.run_id, name))
        rows.append(table.select(*stamp, F.lit(name).alias("metric"), F.to_json(F.struct(*table.columns)).alias("dims")))
    layers.append("ops", "run_metrics", _union(rows))
    return RunResult(config.run_id, linked.thresholds, report, digest, same, seconds)


def _write_offenders(layers: Layers, attempt: str, rows: DataFrame) -> str:
    layers.replace("ops", f"offenders/{attempt}", rows)
    return layers.path("ops", f"offenders/{attempt}")


def _record_timing(spark: SparkSession, root: str, run_id: str, attempt: str, scores: dict[str, DataFrame]) -> DataFrame | None:
    """Batch times of this run put over those of earlier runs; a repeated batch keeps its pair count."""
    ops = VersionedTables(spark, os.path.join(root, "ops"))
    timing = ops.read("timing")
    if not scores:
        return timing
    new = scoring.batch_timing(_union(list(scores.values())), run_id)
    if timing is not None:
        new = upsert(timing, new, ("run_id", "batch_id", "checkpoint"), ("load_s", "infer_s"))
    timing = ops.write(attempt, "timing", new)
    ops.publish(attempt, ["timing"])
    return timing


def _report(root: str, config: RunConfig, linked: Linked, timing: DataFrame | None) -> dict[str, DataFrame]:
    true_pairs = {r["split"]: r["true_pairs"] for r in metrics.true_pair_counts(linked.truth).collect()}
    decided = _union([
        _tagged(d.where(F.col("is_match").isNotNull()).select("decision", "split", "is_match"), config=name) for name, d in linked.decisions.items()])
    report = {
        "oversized_blocks": metrics.oversized_summary(Layers(linked.pairs.sparkSession, root).read("ops", "oversized_blocks")),
        "volumes": metrics.volume_counts(linked.entities, linked.pairs, linked.master),
        "blocking": metrics.blocking_recall(linked.labeled, linked.truth),
        "configs": metrics.config_metrics(decided, true_pairs.get("test", 0)),
    }
    if linked.scores:
        own = timing.where(F.col("run_id") == config.run_id)
        every = _union(list(linked.scores.values()))
        rules = linked.decisions[RULES]
        report["cascade"] = _union([
            _tagged(metrics.cascade_metrics(rules, linked.decisions[config_name(name)],
                                            own.where(F.col("checkpoint") == name)), checkpoint=name)
            for name in linked.scores
        ])
        report["scores"] = _union([
            metrics.score_metrics(every, linked.labeled, own, name, config.cost_per_hour) for name in linked.scores
        ])
    return report


def same_digest_as_last(history: DataFrame, digest: str) -> DataFrame:
    """One row: the last stored gold hash, and whether ``digest`` equals it (NULL on a first run)."""
    stored = history.where(F.col("metric") == "gold_hash").agg(
        F.max_by(F.get_json_object("dims", "$.hash"), "created_at").alias("stored"))
    return stored.select("stored", (F.col("stored") == digest).alias("identical"))
