"""Mixing sources to target weights with soft membership.

A classifier learned from a table of labelled documents gives every document a probability per
domain: naive Bayes over a document's source, language and coarse text statistics and, if asked for,
its words. Words are counted by domain over a sample of at most ``SAMPLE`` labelled texts of one fold;
those whose log ratio between a domain and the others is surely not zero, at most ``MAX_WORDS`` of
them, are the word model, one bounded array. Their ratios are summed over a document's distinct words
inside its row, and the levels of the sums are one more feature. Its probabilities are counted like
those of all other features, from the labelled documents of the other fold, so they do not believe in
what was only learned by heart. Each document then gets a rate, how often it is taken in the mean, such
that the expected tokens per domain, the sum over documents of rate times tokens times membership,
match the targets as well as nonnegative rates can: least squares by projected gradient steps, started
at rate one. ``misses`` tells what is left.

A step lowers a document's rate by its memberships times one number per domain: the misses of the
domains, scaled by the second moments of the memberships, so that overlapping domains don't slow it
down. So documents with equal features get equal rates, sums are taken over cells of equal
features, and the rates follow from the few numbers of each step; no step writes a table. All work
on rows is done by DataFrame functions; the driver holds a few numbers per domain.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowkin.llm.tables import count_words
from rowkin.session import stage

SMOOTHING = 1.0
MAX_STEPS = 40
MAX_RATE = math.inf  # rates have no upper bound
CLOSE = 1e-9  # misses below this share of all tokens count as none
LENGTHS = (1.0, 0.5, 0.2, 0.05)
LEAST_GAIN = 1e-5  # a step that lowers the squared error by less than this share is the last
BROADCAST_CELLS = 50_000  # more cells than this are joined by a shuffle

NO_WORD = r"[^\p{L}\p{N}]+"
SURE = 3.0  # standard errors from which on a word's log ratio counts
WORD_LEVELS = (-4.0, -1.0, 1.0, 4.0)  # cuts of the summed log ratios
WORD_UNIT = 1000  # log ratios are summed as whole numbers, so their order does not matter
SAMPLE = 40_000  # labelled documents at most that word weights are learned from
MAX_WORDS = 8_192  # of the word model, those whose ratios are surest
CELLS = 1 << 14  # of the array that the word model is looked up in

FEATURES = ("_mix_source", "_mix_lang", "_mix_length", "_mix_symbols", "_mix_capitals", "_mix_digits")
WORDS = "_mix_words"
TOKENS = "_mix_tokens"


def with_features(docs: DataFrame) -> DataFrame:
    """``docs`` with its number of words and one column per feature. Nulls count as empty.

    Columns of the input whose names start with ``_mix_`` are replaced.
    """
    text = F.coalesce("text", F.lit(""))
    chars = F.greatest(F.length(text), F.lit(1))
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / chars
    level = lambda value, *cuts: sum((F.when(F.col(value) >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("string")
    counted = docs.withColumns({
        "_mix_source": F.coalesce(F.col("source").cast("string"), F.lit("")), "_mix_lang": F.coalesce(F.col("lang").cast("string"), F.lit("")),
        TOKENS: count_words(text), "_mix_symbols": share(r"[#*$%&|<>]"), "_mix_capitals": share("[A-Z]"), "_mix_digits": share("[0-9]")})
    return counted.withColumns({
        "_mix_length": level(TOKENS, 20, 100, 300, 1000, 5000), "_mix_symbols": level("_mix_symbols", 0.001, 0.02),
        "_mix_capitals": level("_mix_capitals", 0.005, 0.05, 0.3), "_mix_digits": level("_mix_digits", 0.0001, 0.01)})


def _distinct_words() -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), NO_WORD)), lambda w: w != "")


def _learns_words(doc_id: Column) -> Column:
    """Whether a labelled document is of the fold that word weights are learned from; the others give their probabilities."""
    return F.pmod(F.xxhash64(F.lit("fold"), doc_id), F.lit(2)) == 0


def sampled(known: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """At most about ``bound`` of the labelled documents, the same in every run: those with the least hashes."""
    n = known.count()
    if n <= bound:
        return known
    share = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1 << 30))
    return known.where(share < int(bound / n * (1 << 30)))


def word_weights(docs: DataFrame, known: DataFrame, domains: Sequence[str]) -> DataFrame:
    """(word, seen, w0, w1, …): labelled documents with the word, and its log ratio per domain in 1/WORD_UNIT.

    The ratio is of the word's share of the domain's labelled documents to that of all other
    labelled ones; it is 0 if it may be by chance, and words with zeros only are left out. Of the rest
    the ``MAX_WORDS`` whose largest ratio has the most standard errors are kept, ties by the word.
    """
    k = len(domains)
    labelled = docs.join(known, "doc_id")
    each = [F.count_if(F.col("domain") == d).alias(f"n{i}") for i, d in enumerate(domains)]
    of = docs.select("doc_id").join(known, "doc_id").agg(*each).first()
    counts = labelled.select("domain", F.explode(_distinct_words()).alias("word")).groupBy("word").agg(F.count("*").alias("seen"), *each)

    def ratio(i: int) -> tuple[Column, Column]:
        own, other = F.col(f"n{i}") + 0.5, F.col("seen") - F.col(f"n{i}") + 0.5
        own_all, other_all = of[i] + 1.0, sum(of) - of[i] + 1.0
        value = F.log(own / own_all) - F.log(other / other_all)
        return value, F.abs(value) / F.sqrt(1 / own - 1 / own_all + 1 / other - 1 / other_all)

    def weight(i: int) -> Column:
        value, errors = ratio(i)
        return F.when(errors > SURE, F.round(WORD_UNIT * value)).otherwise(0).cast("bigint").alias(f"w{i}")

    surest = F.array_max(F.array(*[ratio(i)[1] for i in range(k)])).alias("errors")
    weights = counts.select("word", "seen", surest, *[weight(i) for i in range(k)]).where(" OR ".join(f"w{i} <> 0" for i in range(k)))
    return weights.orderBy(F.desc("errors"), "word").limit(MAX_WORDS).drop("errors")


def _cell(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(CELLS)).cast("int")


def word_model(weights: DataFrame, k: int) -> Column:
    """An array with the words of each cell and their weights, as one constant. ``MAX_WORDS`` and ``CELLS`` bound what the driver gets."""
    cells: list[list | None] = [None] * CELLS
    for row in sorted(weights.select(_cell(F.col("word")).alias("cell"), "word", *[f"w{i}" for i in range(k)]).collect()):
        cells[row["cell"]] = [*(cells[row["cell"]] or []), {"word": row["word"], "w": [row[f"w{i}"] for i in range(k)]}]
    return F.from_json(F.lit(json.dumps(cells)), "array<array<struct<word: string, w: array<bigint>>>>")


def found_words(model: Column) -> Column:
    """Those of a row's distinct words that the model has, with their weights."""
    hit = lambda w: F.filter(F.get(model, _cell(w)), lambda e: e["word"] == w)
    known = F.filter(_distinct_words(), lambda w: F.get(model, _cell(w)).isNotNull())
    return F.flatten(F.transform(known, hit))


def word_levels(found: str, k: int) -> Column:
    """The levels of the summed ratios of a row's words, as text."""
    total = lambda i: F.aggregate(found, F.lit(0).cast("bigint"), lambda s, e: s + F.get(e["w"], F.lit(i)))
    score = [total(i) for i in range(k)]
    level = [sum((F.when(v >= int(c * WORD_UNIT), 1).otherwise(0) for c in WORD_LEVELS), F.lit(0)).cast("string") for v in score]
    return F.concat(*level)


def membership(cells: DataFrame, domains: Sequence[str], features: Sequence[str] = FEATURES) -> DataFrame:
    """``cells`` with the column ``p``, the probability of each domain.

    ``cells`` has the features and ``labelled``, an array with the number of labelled documents per
    domain. Without any label all domains are equally likely.
    """
    k = len(domains)
    each = [F.sum(F.get("labelled", F.lit(i))).alias(f"n{i}") for i in range(k)]
    prior = cells.agg(*each).first()
    counts = [prior[i] or 0 for i in range(k)]
    values = [F.count_distinct(f).alias(f) for f in features]
    distinct = cells.agg(*values).first()
    log_p = F.array(*[F.lit(float(c + SMOOTHING)) for c in counts])
    scored = cells.withColumn("log_p", F.transform(log_p, lambda v: F.log(v / (sum(counts) + SMOOTHING * k))))
    for feature in features:
        table = cells.groupBy(feature).agg(F.array(*each).alias("seen"))
        total = F.array(*[F.lit(float(c + SMOOTHING * distinct[feature])) for c in counts])
        likelihood = F.zip_with("seen", total, lambda s, t: F.log((s + SMOOTHING) / t))
        table = table.select(feature, likelihood.alias("likelihood"))
        scored = scored.join(table, feature).withColumn("log_p", F.zip_with("log_p", "likelihood", lambda a, b: a + b)).drop("likelihood")
    odds = F.transform("log_p", lambda v: F.exp(v - F.array_max("log_p")))
    scored = scored.withColumn("odds", odds)
    whole = F.aggregate("odds", F.lit(0.0), lambda a, b: a + b)
    return scored.withColumn("p", F.transform("odds", lambda v: v / whole)).drop("log_p", "odds")


def solved(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Solution of a small positive definite system by elimination."""
    rows = [[*r, b] for r, b in zip(matrix, right, strict=True)]
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            f = rows[j][i] / rows[i][i]
            rows[j] = [x - f * y for x, y in zip(rows[j], rows[i], strict=True)]
    out = [0.0] * len(rows)
    for i in reversed(range(len(rows))):
        out[i] = (rows[i][-1] - sum(rows[i][j] * out[j] for j in range(i + 1, len(rows)))) / rows[i][i]
    return out


def _vectors(vectors: Sequence[Sequence[float]]) -> Column:
    # As one literal: the generated code stays the same from step to step.
    return F.lit([list(map(float, v)) for v in vectors]) if vectors else F.array().cast("array<array<double>>")


def _lowered(rate: Column, step: Column) -> Column:
    """The rate after a step, from the memberships ``p``."""
    by = F.aggregate(F.zip_with("p", step, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return F.greatest(rate - by, F.lit(0.0))


def _rate(steps: Sequence[Sequence[float]]) -> Column:
    return F.aggregate(_vectors(steps), F.lit(1.0), _lowered)


def fit_rates(cells: DataFrame, targets: Sequence[float]) -> DataFrame:
    """``cells`` (_mix_tokens, p) with ``rate``. Targets are weights; their sum stands for all tokens."""
    k, tokens = len(targets), F.col(TOKENS)
    p = [F.get("p", F.lit(i)) for i in range(k)]
    whole = cells.agg(F.sum(tokens).alias("t"), F.sum(tokens * F.aggregate("p", F.lit(0.0), lambda a, b: a + b * b)).alias("trace")).first()
    total = whole["t"] or 0
    if not total:
        return cells.withColumn("rate", F.lit(1.0))
    goal = [t / sum(targets) for t in targets]

    def best(steps: list[list[float]], candidates: list[list[float]]) -> tuple[float, list[float], list[list[float]], list[float]]:
        """(squared error, step, misses, second moments of cells that no bound holds) of the best next step."""
        rated = cells.select(tokens, "p", _rate(steps).alias("r")).select(TOKENS, "p", "r", F.posexplode(_vectors(candidates)).alias("at", "step"))
        rated = rated.withColumn("r", _lowered(F.col("r"), F.col("step")))
        free = F.when(F.col("r") > 0, tokens).otherwise(0.0)
        found = rated.groupBy("at").agg(*[F.sum(F.col("r") * tokens * p[i]).alias(f"s{i}") for i in range(k)],
                                        *[F.sum(free * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(k)]).collect()
        out = []
        for row in found:
            miss = [row[f"s{i}"] / total - goal[i] for i in range(k)]
            moments = [[row[f"m{i}_{j}"] / total + (1e-9 if i == j else 0.0) for j in range(k)] for i in range(k)]
            out.append((sum(m * m for m in miss), candidates[row["at"]], miss, moments))
        return min(out, key=lambda o: o[0])

    steps: list[list[float]] = []
    error, _, miss, moments = best(steps, [[0.0] * k])
    for _ in range(MAX_STEPS):
        if error < CLOSE**2:
            break
        # The step scaled by the moments, whole or shortened where bounds bend it, or the plain one,
        # which always lowers the error.
        scaled = solved(moments, miss)
        candidates = [[x * length for x in scaled] for length in LENGTHS] + [[m * total / whole["trace"] for m in miss]]
        after, step, later, moved = best(steps, candidates)
        if after >= error * (1 - LEAST_GAIN):
            break
        steps, error, miss, moments = [*steps, step], after, later, moved
    return cells.withColumn("rate", _rate(steps))


def _known(labels: DataFrame, domains: Sequence[str]) -> DataFrame:
    return labels.where(F.col("domain").isin(*domains) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))


def _counted(docs: DataFrame, known: DataFrame, domains: Sequence[str], words: bool) -> tuple[DataFrame, tuple[str, ...], DataFrame]:
    """``docs`` with its features, their names, and the labelled documents that give probabilities."""
    counted = with_features(docs)
    if not words:
        return counted, FEATURES, known
    learns = _learns_words(F.col("doc_id"))
    texts = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    weights = stage(word_weights(texts, F.broadcast(sampled(known.where(learns))), domains), "words")  # SAMPLE bounds its size
    found = counted.withColumn(WORDS, found_words(word_model(weights, len(domains))))
    return found.withColumn(WORDS, word_levels(WORDS, len(domains))), (*FEATURES, WORDS), known.where(~learns)


def _rated_cells(counted: DataFrame, known: DataFrame, domains: Sequence[str], targets: Mapping[str, float],
                 features: Sequence[str]) -> DataFrame:
    marked = counted.join(known, "doc_id", "left")
    number = [F.count_if(F.col("domain") == d).cast("double") for d in domains]
    cells = stage(marked.groupBy(*features).agg(F.sum(TOKENS).cast("double").alias(TOKENS), F.array(*number).alias("labelled")), "cells")
    rated = fit_rates(stage(membership(cells, domains, features), "members"), [targets[d] for d in domains])
    return stage(rated.select(*features, TOKENS, "rate", "p"), "rated")


def _with_cells(rows: DataFrame, cells: DataFrame, features: Sequence[str]) -> DataFrame:
    small = cells.count() <= BROADCAST_CELLS
    found = cells.select(*features, "rate", "p")
    return rows.join(F.broadcast(found) if small else found, list(features))


def misses(rated: DataFrame, targets: Mapping[str, float]) -> DataFrame:
    """(domain, target, expected, miss): shares of the expected tokens under the fitted rates.

    ``rated`` is what ``mix`` returns. ``expected`` is of the tokens of all documents, as the targets
    are, so it does not add up to one where these cannot be met. Without tokens it is null.
    """
    domains = sorted(targets)
    share = [F.sum(F.col("rate") * F.col("tokens") * F.col(f"p_{d}")) / F.sum("tokens") for d in domains]
    row = rated.agg(F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(targets[d] / sum(targets.values())).alias("target"), s.alias("expected"))
                              for d, s in zip(domains, share, strict=True)]).alias("each"))
    return row.select(F.explode("each").alias("e")).select("e.*", (F.col("e.expected") - F.col("e.target")).alias("miss"))


def mix(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float], words: bool = False) -> DataFrame:
    """(doc_id, tokens, rate, and p_<domain> per domain) per row of ``docs``.

    ``labels`` is (doc_id, domain); labels of other domains, with nulls or for unknown documents are
    left out, and a document with several labels counts for its smallest. Rows that repeat a
    document or have no id are rows of their own; a text without words has no tokens but a rate.
    ``words`` lets the classifier read the words of the texts.
    """
    domains = sorted(targets)
    counted, features, judges = _counted(docs.select("doc_id", "text", "source", "lang"), _known(labels, domains), domains, words)
    counted = stage(counted.select("doc_id", TOKENS, *features), "features")
    rated = _rated_cells(counted, judges, domains, targets, features)
    columns = [F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(domains)]
    return _with_cells(counted, rated, features).select("doc_id", F.col(TOKENS).alias("tokens"), "rate", *columns)


def take(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float], words: bool = False) -> DataFrame:
    """Rows of ``docs`` as often as their rate says: its whole part, and once more with the rest as probability.

    The draw is a hash of id and text, so a second run takes the same rows. Texts are never copied:
    they are looked at once for the rates and once more for the rows that are taken.
    """
    domains, names = sorted(targets), docs.columns
    counted, features, judges = _counted(docs, _known(labels, domains), domains, words)
    rated = _rated_cells(counted.select("doc_id", TOKENS, *features), judges, domains, targets, features)
    draw = (F.pmod(F.xxhash64(F.lit("take"), "doc_id", "text"), F.lit(1 << 20)) + 0.5) / (1 << 20)
    often = F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    copies = F.when(often > 0, F.sequence(F.lit(1), often.cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = _with_cells(counted, rated, features)
    return rows.select(*names, F.explode(copies).alias("_mix_copy")).drop("_mix_copy")
