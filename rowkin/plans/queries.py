"""The registered queries: every operator on the given tables, or on data derived from them.

Each query takes (spark, folder) and returns a DataFrame. Dates and times come out as text, and
doubles rounded to six digits, so that another engine's result compares by value.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowkin.functions.text import norm_text
from rowkin.operators import blocking, cascade, cluster_updates, decide, digest, golden, mentions, metrics, pairs, quality, scoring, setjoin
from rowkin.operators.components import clusters, cross_reference
from rowkin.operators.entities import ENTITY_COLUMNS, all_entities, billing_entities, crm_entities
from rowkin.operators.upsert import overlay, upsert
from rowkin.plans import fixture as src
from rowkin.plans.run import RunConfig, build_gold, entity_contracts, link, pair_contracts, same_digest_as_last, score_review
from rowkin.session import scratch_root, spread, stage
from rowkin.sources import csv_tables
from rowkin.sources.tables import Layers, VersionedTables

# Given models, so that another engine can compute the same decisions: one weight per design
# column (email, phone, birth, city: equal / different; name; address; second score).
GIVEN_RULES = decide.Weights((5.0, -0.9, 4.5, -1.0, 3.0, -2.5, 0.5, -0.5, 6.0, 4.0), -10.37)
GIVEN_SECOND = decide.Weights((3.0, -0.6, 2.5, -0.8, 2.0, -1.5, 0.3, -0.3, 4.0, 2.0, 6.0), -9.43)
RUN_ID, SCORER, SMALL_BATCH = "given", "overlap", 20
SIMILAR_NAMES = 60  # per cent
SMALL_BLOCK = 4  # a limit that many blocks of the derived sources exceed
LOAD_SECONDS, SECONDS_PER_PAIR, COST_PER_HOUR = 10.0, 0.4, 0.30


def plain(df: DataFrame) -> DataFrame:
    """Dates and times as text, doubles with six digits."""
    columns = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            columns.append(F.date_format(f.name, "yyyy-MM-dd HH:mm:ss").alias(f.name))
        elif isinstance(f.dataType, T.DateType):
            columns.append(F.col(f.name).cast("string").alias(f.name))
        elif isinstance(f.dataType, T.DoubleType):
            columns.append(F.round(f.name, 6).alias(f.name))
        else:
            columns.append(F.col(f.name))
    return df.select(*columns)


class Tables:
    """The given tables, and the stages of a linkage derived from ``customer``."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.folder = spark, folder

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.folder, f"{name}.parquet"))

    def scratch(self) -> str:
        """A new folder for tables that a query writes and reads again."""
        return os.path.join(scratch_root(self.spark), f"tables-{uuid.uuid4().hex}")

    def rows(self) -> DataFrame:
        return src.source_rows(spread(self.given("customer")), self.given("nation"))

    def truth(self) -> DataFrame:
        return src.ground_truth(self.rows())

    def entities(self) -> DataFrame:
        rows = self.rows()
        return all_entities(src.crm_users(rows), src.billing_users(rows))

    def staged_entities(self) -> DataFrame:
        return stage(self.entities(), "entities")

    def labeled(self, entities: DataFrame | None = None) -> DataFrame:
        entities = self.staged_entities() if entities is None else entities
        return stage(pairs.build_labeled(entities, self.truth()), "labeled")

    def decided(self, entities: DataFrame | None = None) -> DataFrame:
        """Labelled pairs with the decisions of the given rules, thresholds tuned on dev."""
        return decide.decide(self.labeled(entities), GIVEN_RULES)[0]

    def rooted(self, entities: DataFrame) -> DataFrame:
        decided = self.decided(entities)
        return clusters(entities, decided.where(F.col("decision") == "MATCH").select("left_key", "right_key"))

    def gold(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(master, xref, entities)."""
        entities = self.staged_entities()
        master, xref = build_gold(entities, self.decided(entities))
        return master, xref, entities

    def second_stage(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(rules decisions, scores, cascade decisions) with the given models."""
        entities = self.staged_entities()
        rules = self.decided(entities)
        scores = score_review(rules, entities, scoring.ColumnScorer(SCORER, scoring.token_overlap), scoring.BATCH_SIZE)
        queue = stage(cascade.review_rows(rules, scores), "queue")
        second, _ = decide.decide(queue, GIVEN_SECOND, None, "p_same")
        return rules, scores, cascade.merge_stages(rules, second)

    def timing(self, scores: DataFrame) -> DataFrame:
        """Batch times from the batch sizes: a fixed load time and a fixed time per pair."""
        return scoring.batch_timing(scores, RUN_ID).withColumns({
            "load_s": F.lit(LOAD_SECONDS), "infer_s": F.col("pairs") * SECONDS_PER_PAIR})


# --- sources and entities ---------------------------------------------------------------------

def bronze_csv(t: Tables) -> DataFrame:
    path = os.path.join(t.scratch(), "billing_users")
    csv_tables.write_text_csv(src.billing_users(t.rows()), path)
    return csv_tables.read_text_csv(t.spark, path, csv_tables.BILLING_COLUMNS).drop("_ingested_at")


def ragged_csv(t: Tables) -> DataFrame:
    """Customers as CSV lines, some a field short and some a field over: what is kept and what goes to quarantine."""
    columns = ("c_custkey", "c_name", "c_mktsegment")
    number = F.col("c_custkey")
    quoted = [F.concat(F.lit('"'), F.coalesce(F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit("")), F.lit('"')) for c in columns]
    line = F.when(number % 7 == 3, F.concat_ws(",", *quoted[:2])).when(number % 11 == 5, F.concat_ws(",", *quoted, quoted[0])).otherwise(F.concat_ws(",", *quoted))
    path = os.path.join(t.scratch(), "ragged")
    t.given("customer").select(line.alias("value")).write.text(path)
    rows, odd = csv_tables.read_checked_csv(t.spark, path, columns, stamp=False, header=False)
    kept = rows.select(F.lit("kept").alias("kind"), F.concat_ws("|", *columns).alias("record"))
    return kept.unionByName(odd.select(F.lit("quarantined").alias("kind"), "record"))


def document_words(t: Tables) -> DataFrame:
    words = t.given("documents").select("doc_id", norm_text("text").alias("words"))
    return words.select("doc_id", F.length("words").cast("bigint").alias("n_chars"), F.md5("words").alias("digest"))


# --- pairs ------------------------------------------------------------------------------------

def block_sizes(t: Tables) -> DataFrame:
    return blocking.block_sizes(blocking.block_rows(t.entities()))


def silver_contracts(t: Tables) -> DataFrame:
    """The contracts that every run checks, on entities and decided pairs."""
    entities = t.staged_entities()
    decided = t.decided(entities).select(*pairs.PAIR_COLUMNS, "p_match", "decision", F.lit(None).cast("string").alias("batch_id"))
    return entity_contracts(entities).unionByName(pair_contracts(stage(decided, "decided"), entities))


def half_labeled_decisions(t: Tables) -> DataFrame:
    """Labels for the persons with an even number only: all pairs are decided all the same."""
    entities = t.staged_entities()
    truth = t.truth().where(F.right("true_entity_id", F.lit(1)).cast("int") % 2 == 0)
    marked = stage(pairs.build_marked(entities, truth), "marked")
    return decide.decide(marked, GIVEN_RULES)[0].select("pair_id", "is_match", "p_match", "decision")


def pair_features(t: Tables) -> DataFrame:
    entities = t.staged_entities()
    return pairs.pair_features(blocking.candidate_pairs(entities), entities)


def blocking_recall(t: Tables) -> DataFrame:
    return metrics.blocking_recall(t.labeled(), t.truth())


# --- given text -------------------------------------------------------------------------------

def _texts(t: Tables) -> DataFrame:
    """Documents and pages as records with a text."""
    docs = t.given("documents").select(F.concat(F.lit("doc:"), "doc_id").alias("entity_key"), "text")
    return docs.unionByName(t.given("pages").select(F.concat(F.lit("page:"), "page_id").alias("entity_key"), F.col("html").alias("text")))


def mention_keys(t: Tables) -> DataFrame:
    return mentions.linked(_texts(t))[2]


def mention_clusters(t: Tables) -> DataFrame:
    """Documents and pages that mention the same e-mails and telephone numbers."""
    return mentions.linked(_texts(t))[0]


def mention_survivors(t: Tables) -> DataFrame:
    return mentions.survivors(*mentions.linked(_texts(t))[:2])


def similar_names(t: Tables) -> DataFrame:
    """Names of one city whose words are alike, without comparing all names of the city."""
    names = t.staged_entities().select(F.col("city").alias("block"), F.split("full_name_norm", " ").alias("tokens"))
    found = setjoin.similar_sets(names, SIMILAR_NAMES)
    return found.select("block", F.array_join("left_tokens", " ").alias("left_tokens"), F.array_join("right_tokens", " ").alias("right_tokens"), "shared", "total")


# --- decisions --------------------------------------------------------------------------------

def _scored(t: Tables) -> DataFrame:
    return t.labeled().withColumn("p_match", decide.match_probability(GIVEN_RULES))


def _curve(t: Tables) -> DataFrame:
    return decide.threshold_curve(_scored(t).where(F.col("split") == "dev"))


def rules_stage(t: Tables) -> DataFrame:
    return decide.decision_rows(decide.run_config(t.labeled())[0])


def pair_update(t: Tables) -> DataFrame:
    """Decisions written back to the pairs (update by join)."""
    rules = t.decided()
    empty = rules.select("pair_id", "left_key", "right_key", F.lit(None).cast("double").alias("p_match"),
                         F.lit(None).cast("string").alias("decision"))
    return overlay(empty, rules, "pair_id", ("p_match", "decision"))


# --- second stage -----------------------------------------------------------------------------

def score_batches(t: Tables) -> DataFrame:
    return scoring.plan_batches(t.decided().where(F.col("decision") == "REVIEW"))


def _load_overlap() -> Callable[[Sequence[str], Sequence[str]], list[float]]:
    import re

    def words(text: str) -> set[str]:
        return set(re.split("[ ;]+", text))

    def score(left: Sequence[str], right: Sequence[str]) -> list[float]:
        return [len(words(a) & words(b)) / len(words(a) | words(b)) for a, b in zip(left, right, strict=True)]

    return score


def scored_queue(t: Tables) -> DataFrame:
    """The queue scored batch by batch in Python workers."""
    entities = t.staged_entities()
    scorer = scoring.BatchScorer(SCORER, _load_overlap)
    scores = score_review(t.decided(entities), entities, scorer, scoring.BATCH_SIZE)
    return scores.select("pair_id", "batch_id", "checkpoint", "p_same")


NO_MODEL_FOR = "city=nation 2;"


def _load_partial() -> Callable[[Sequence[str], Sequence[str]], list[float]]:
    def score(left: Sequence[str], right: Sequence[str]) -> list[float]:
        if any(NO_MODEL_FOR in text for text in left):
            raise ValueError("no model for this city")
        return [0.5] * len(left)

    return score


def failed_batches(t: Tables) -> DataFrame:
    """Batches of the queue that a scorer could not score, and why."""
    entities = t.staged_entities()
    queue = t.decided(entities).where(F.col("decision") == "REVIEW")
    batched = queue.join(scoring.plan_batches(queue, SMALL_BATCH), "pair_id")
    scored = scoring.score_queue(scoring.scoring_input(batched, entities), scoring.BatchScorer("partial", _load_partial))
    return scoring.failed_batches(scored)


def resumed_scores(t: Tables) -> DataFrame:
    """A scorer that fails for one city, then one that does not: only the failed batches are scored again."""
    entities, layers = t.staged_entities(), Layers(t.spark, t.scratch())
    queue = stage(t.decided(entities).where(F.col("decision") == "REVIEW"), "queue")
    batched = queue.join(scoring.plan_batches(queue, SMALL_BATCH), "pair_id")
    texts = stage(scoring.scoring_input(batched, entities), "texts")
    stage(scoring.resume_scores(texts, scoring.BatchScorer("resumed", _load_partial), layers), "scores")
    scored = scoring.resume_scores(texts, scoring.BatchScorer("resumed", _load_overlap), layers)
    return scored.select("pair_id", "batch_id", "checkpoint", "p_same")


def cascade_fitted(t: Tables) -> DataFrame:
    rules, scores, _ = t.second_stage()
    return decide.decision_rows(cascade.run_cascade(rules, scores)[0])


def config_metrics(t: Tables) -> DataFrame:
    rules, _, final = t.second_stage()
    names = {"rules": rules, f"rules+score_{SCORER}": final}
    parts = [d.select(F.lit(name).alias("config"), "decision", "split", "is_match") for name, d in names.items()]
    true_pairs = {r["split"]: r["true_pairs"] for r in metrics.true_pair_counts(t.truth()).collect()}
    return metrics.config_metrics(parts[0].unionByName(parts[1]), true_pairs.get("test", 0))


def cascade_metrics(t: Tables) -> DataFrame:
    rules, scores, final = t.second_stage()
    return metrics.cascade_metrics(rules, final, t.timing(scores))


def score_metrics(t: Tables) -> DataFrame:
    rules, scores, _ = t.second_stage()
    return metrics.score_metrics(scores, rules, t.timing(scores), SCORER, COST_PER_HOUR)


def auc_by_rules(t: Tables) -> DataFrame:
    return metrics.auc_table(_scored(t).where(F.col("split") == "test"), "p_match", "is_match")


def auc_by_length(t: Tables) -> DataFrame:
    rated = t.given("documents").select("doc_id", "n_chars").join(t.given("labels"), "doc_id")
    return metrics.auc_table(rated, "n_chars", "quality")


def auc_by_source(t: Tables) -> DataFrame:
    """How well the length of a document tells its quality, for every source in one pass."""
    rated = t.given("documents").select("doc_id", "source", "n_chars").join(t.given("labels"), "doc_id")
    return metrics.auc_table(rated, "n_chars", "quality", ["source"])


def review_queue(t: Tables) -> DataFrame:
    entities = t.staged_entities()
    return scoring.review_queue(t.decided(entities), entities)


# --- gold -------------------------------------------------------------------------------------

def cluster_roots(t: Tables) -> DataFrame:
    return t.rooted(t.staged_entities())


def _updated(t: Tables) -> tuple[DataFrame, cluster_updates.ClusterUpdate, DataFrame, DataFrame]:
    """(entities, update, masters before it, entities in review): a quarter of the entities and half of the matches arrive later."""
    entities = t.staged_entities()
    decided = t.decided(entities)
    matches = stage(decided.where(F.col("decision") == "MATCH").select("pair_id", "left_key", "right_key"), "matches")
    early = lambda key: F.md5(F.col(key)) >= "4"
    at_first = (F.col("pair_id") < "8") & early("left_key") & early("right_key")
    first = entities.where(early("entity_key"))
    xref = stage(cross_reference(clusters(first, matches.where(at_first))), "xref")
    review = golden.pending_entities(decided)
    master = golden.golden_records(first, xref, review)
    return entities, cluster_updates.update_clusters(xref, entities, matches.where(~at_first)), master, review


def updated_clusters(t: Tables) -> DataFrame:
    """Ids after the update, and where ids that vanished lead."""
    update = _updated(t)[1]
    ids = update.xref.select(F.lit("member").alias("kind"), F.col("entity_key").alias("key"), "master_id")
    return ids.unionByName(update.redirects.select(F.lit("redirect").alias("kind"), F.col("master_id").alias("key"), F.col("now").alias("master_id")))


def updated_masters(t: Tables) -> DataFrame:
    entities, update, master, review = _updated(t)
    return cluster_updates.refreshed_masters(master, entities, update, review)


def pending_review(t: Tables) -> DataFrame:
    return golden.pending_entities(t.decided(t.staged_entities()))


def event_survivors(t: Tables) -> DataFrame:
    """Per user the latest values that are present; errors and small amounts count as missing."""
    events = t.given("events").select(
        "user_id", "ts", "event_id",
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type"),
        F.when(F.col("value") >= 10, F.col("value")).alias("value"),
        F.get_json_object("props", "$.k").alias("k"),
    )
    return events.groupBy("user_id").agg(
        *[golden.latest_present(c, "ts", "event_id") for c in ("event_type", "value", "k")],
        F.count("*").alias("events"))


def quality_checks(t: Tables) -> DataFrame:
    master, xref, entities = t.gold()
    return quality.gold_checks(stage(master, "master"), xref, entities)


def gate_drill(t: Tables) -> DataFrame:
    """The checks on a master table in which the first record appears twice."""
    master, xref, entities = t.gold()
    master = stage(master, "master")
    return quality.gold_checks(master.unionByName(master.orderBy("master_id").limit(1)), xref, entities)


def gate_drill_same_run(t: Tables) -> DataFrame:
    """A second attempt under the same run id that the gate refuses: what readers see before and after."""
    tables, config = VersionedTables(t.spark, t.scratch()), RunConfig(run_id="same")
    names = ["customer_master", "customer_xref"]
    master, xref, entities = t.gold()
    master = stage(master, "master")
    first = config.attempt()
    tables.write(first, names[0], master), tables.write(first, names[1], xref.select("entity_key", "master_id"))
    tables.publish(first, names)
    before = digest.combined_digest(list(tables.snapshot(names).values()))
    second = config.attempt()
    doubled = tables.write(second, names[0], master.unionByName(master.orderBy("master_id").limit(1)))
    tables.write(second, names[1], xref.select("entity_key", "master_id"))
    refused = False
    try:
        quality.require(quality.gold_checks(doubled, xref, entities))
        tables.publish(second, names)
    except quality.GateFailed:
        refused = True
    now = tables.snapshot(names)
    same = digest.combined_digest(list(now.values())) == before
    return now[names[0]].agg(F.count("*").alias("masters")).select("masters", F.lit(refused).alias("refused"), F.lit(same).alias("unchanged"))


def rerun_same_id(t: Tables) -> DataFrame:
    """Two published attempts under one run id, and the timing of both put over each other."""
    tables, config = VersionedTables(t.spark, t.scratch()), RunConfig(run_id=RUN_ID)
    _, scores, _ = t.second_stage()
    timing = stage(t.timing(scores), "timing")
    for factor in (1.0, 3.0):
        new = timing.withColumn("infer_s", F.col("infer_s") * factor)
        old = tables.read("timing")
        attempt = config.attempt()
        tables.write(attempt, "timing", new if old is None else upsert(old, new, ("run_id", "batch_id", "checkpoint"), ("load_s", "infer_s")))
        tables.publish(attempt, ["timing"])
    return tables.read("timing")


def _contracts(t: Tables) -> list[tuple[str, DataFrame, quality.Contract]]:
    orders, items = t.given("orders"), t.given("lineitem")
    on_orders = quality.Contract(
        required=("o_orderkey", "o_custkey"), keys=(("o_orderkey",),), allowed={"o_orderstatus": ("O", "F")},
        ranges={"o_totalprice": (1000, 400000)}, references={"o_custkey": (t.given("customer"), "c_custkey")})
    on_items = quality.Contract(
        required=("l_orderkey", "l_quantity"), keys=(("l_orderkey", "l_linenumber"),), allowed={"l_returnflag": ("A", "N")},
        ranges={"l_discount": (0, 0.05)},
        references={"l_orderkey": (orders, "o_orderkey"), "l_partkey": (t.given("part"), "p_partkey"),
                    "l_suppkey": (t.given("supplier"), "s_suppkey")})
    return [("orders", orders, on_orders), ("lineitem", items, on_items)]


def order_contracts(t: Tables) -> DataFrame:
    orders, items = [quality.contract_checks(*c) for c in _contracts(t)]
    return orders.unionByName(items)


def order_offenders(t: Tables) -> DataFrame:
    """The first rows behind every failed check, by their text, and how many there are."""
    shown = ("o_orderkey", "o_orderstatus"), ("l_orderkey", "l_linenumber", "l_returnflag")
    orders, items = [quality.contract_offenders(*c, show=s) for c, s in zip(_contracts(t), shown, strict=True)]
    return orders.unionByName(items)


def gate_offenders(t: Tables) -> DataFrame:
    """What the gate shows of a master table in which every master with a pending review appears twice."""
    master, xref, entities = t.gold()
    master = stage(master, "master")
    return quality.gold_offenders(master.unionByName(master.where("has_pending_review")), xref, entities)


def decision_contracts(t: Tables) -> DataFrame:
    labeled = t.labeled()
    rules = decide.decision_rows(decide.decide(labeled, GIVEN_RULES)[0])
    contract = quality.Contract(
        columns=("pair_id", "p_same", "p_match", "decision"), required=("pair_id", "p_match", "decision"),
        keys=(("pair_id",),), allowed={"decision": ("MATCH", "NON_MATCH", "REVIEW")},
        ranges={"p_match": (0, 1), "p_same": (0, 1)}, references={"pair_id": (labeled, "pair_id")})
    return quality.contract_checks("decisions", rules, contract)


def gold_digest(t: Tables) -> DataFrame:
    master, xref, _ = t.gold()
    return digest.table_digest(master).select(F.lit("customer_master").alias("table"), "*").unionByName(
        digest.table_digest(xref.select("entity_key", "master_id")).select(F.lit("customer_xref").alias("table"), "*"))


def _publish(t: Tables, tables: VersionedTables, version: str) -> list[DataFrame]:
    master, xref, entities = t.gold()
    written = [tables.write(version, "customer_master", master),
               tables.write(version, "customer_xref", xref.select("entity_key", "master_id"))]
    tables.publish(version, ["customer_master", "customer_xref"])
    return written


def published_gold(t: Tables) -> DataFrame:
    """Two published versions; what a reader then finds."""
    tables = VersionedTables(t.spark, t.scratch())
    _publish(t, tables, "first")
    _publish(t, tables, "second")
    return tables.read("customer_master")


def idempotence(t: Tables) -> DataFrame:
    """The digest of a second run against the one stored by the first."""
    root = t.scratch()
    tables, layers = VersionedTables(t.spark, root), Layers(t.spark, root)
    first = digest.combined_digest(_publish(t, tables, "first"))
    history = layers.append("ops", "run_metrics", t.spark.range(1, numPartitions=1).select(
        F.lit("first").alias("run_id"), F.lit("gold_hash").alias("metric"),
        F.to_json(F.struct(F.lit(first).alias("hash"))).alias("dims"), F.current_timestamp().alias("created_at")))
    return same_digest_as_last(history, digest.combined_digest(_publish(t, tables, "second")))


def upsert_scores(t: Tables) -> DataFrame:
    """Scores of all pairs, then newer scores of the review queue put over them."""
    rules, scores, _ = t.second_stage()
    old = rules.select("pair_id", F.lit(SCORER).alias("checkpoint"), F.col("p_match").alias("p_same"))
    return upsert(old, scores.select("pair_id", "checkpoint", "p_same"), ("pair_id", "checkpoint"))


def upsert_timing(t: Tables) -> DataFrame:
    """A repeated batch refreshes its times but keeps its number of pairs."""
    _, scores, _ = t.second_stage()
    old = t.timing(scores)
    again = old.withColumns({"pairs": F.lit(0), "load_s": F.lit(1.0), "infer_s": F.col("infer_s") * 2})
    return upsert(old, again, ("run_id", "batch_id", "checkpoint"), ("load_s", "infer_s"))


def upsert_events(t: Tables) -> DataFrame:
    """The state per user and kind of event after all events were put in by time."""
    events = t.given("events").select("user_id", "event_type", "event_id", "value", "ts")
    return upsert(events.limit(0), events, ("user_id", "event_type"), order="event_id")


def volume_counts(t: Tables) -> DataFrame:
    entities = t.staged_entities()
    decided = t.decided(entities)
    return metrics.volume_counts(entities, decided, build_gold(entities, decided)[0])


def linked_customers(t: Tables, scorers: Sequence[scoring.ColumnScorer] = ()) -> DataFrame:
    """A run with fitted models, from the sources to the golden records that go to the gate."""
    rows = t.rows()
    config = RunConfig(scorers=scorers, primary=scorers[0].name if scorers else "baseline")
    return link(t.spark, src.crm_users(rows), src.billing_users(rows), t.truth(), t.scratch(), config).master


QUERIES: dict[str, Callable[[Tables], DataFrame]] = {
    "source_rows": lambda t: t.rows(),
    "ground_truth": lambda t: t.truth(),
    "bronze_csv": bronze_csv,
    "ragged_csv": ragged_csv,
    "crm_entities": lambda t: crm_entities(src.crm_users(t.rows())),
    "billing_entities": lambda t: billing_entities(src.billing_users(t.rows())),
    "entities_all": lambda t: t.entities().select(*ENTITY_COLUMNS),
    "document_words": document_words,
    "block_sizes": block_sizes,
    "candidate_pairs": lambda t: blocking.candidate_pairs(t.staged_entities()),
    "refined_pairs": lambda t: blocking.candidate_pairs(t.staged_entities(), SMALL_BLOCK, levels=(1, 2, 3)),
    "oversized_blocks": lambda t: blocking.oversized_blocks(t.staged_entities(), SMALL_BLOCK),
    "mention_keys": mention_keys,
    "mention_clusters": mention_clusters,
    "mention_survivors": mention_survivors,
    "similar_names": similar_names,
    "silver_contracts": silver_contracts,
    "half_labeled_decisions": half_labeled_decisions,
    "failed_batches": failed_batches,
    "gate_drill_same_run": gate_drill_same_run,
    "rerun_same_id": rerun_same_id,
    "pair_features": pair_features,
    "pairs_filtered": lambda t: pairs.build_pairs(t.staged_entities()),
    "labeled_pairs": lambda t: t.labeled(),
    "split_assignment": lambda t: pairs.split_assignment(t.truth()),
    "true_pair_counts": lambda t: metrics.true_pair_counts(t.truth()),
    "blocking_recall": blocking_recall,
    "rule_scores": lambda t: _scored(t).select("pair_id", "split", "is_match", "p_match"),
    "threshold_curve": _curve,
    "tuned_thresholds": lambda t: decide.tuned_thresholds(_curve(t)),
    "routed_decisions": lambda t: t.decided().select("pair_id", "p_match", "decision"),
    "pair_update": pair_update,
    "rules_stage": rules_stage,
    "score_batches": score_batches,
    "scored_queue": scored_queue,
    "resumed_scores": resumed_scores,
    "cascade_overlay": lambda t: t.second_stage()[2].select("pair_id", "p_match", "decision"),
    "cascade_fitted": cascade_fitted,
    "review_queue": review_queue,
    "config_metrics": config_metrics,
    "cascade_metrics": cascade_metrics,
    "score_metrics": score_metrics,
    "auc_by_rules": auc_by_rules,
    "auc_by_length": auc_by_length,
    "auc_by_source": auc_by_source,
    "cluster_roots": cluster_roots,
    "master_ids": lambda t: cross_reference(t.rooted(t.staged_entities())),
    "golden_records": lambda t: t.gold()[0],
    "updated_clusters": updated_clusters,
    "updated_masters": updated_masters,
    "pending_review": pending_review,
    "event_survivors": event_survivors,
    "quality_checks": quality_checks,
    "gate_drill": gate_drill,
    "order_contracts": order_contracts,
    "order_offenders": order_offenders,
    "gate_offenders": gate_offenders,
    "decision_contracts": decision_contracts,
    "gold_digest": gold_digest,
    "published_gold": published_gold,
    "idempotence": idempotence,
    "upsert_scores": upsert_scores,
    "upsert_timing": upsert_timing,
    "upsert_events": upsert_events,
    "volume_counts": volume_counts,
    "linked_customers": linked_customers,
    "linked_customers_cascade": lambda t: linked_customers(t, [scoring.ColumnScorer(SCORER, scoring.token_overlap)]),
}


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(query: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: plain(query(Tables(spark, folder)))

    return {name: bind(query) for name, query in QUERIES.items()}
