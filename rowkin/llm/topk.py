"""Exact search of the largest inner products by norm buckets.

Candidate vectors are grouped by length, in steps of two per cent, and each group is dealt into
blocks of bounded size: the buckets. Queries are dealt into blocks as well. A first pass over the
longest vectors gives each query a score that its k-th result reaches at least. In the second pass
a query meets only buckets whose length allows that score. Inside a bucket candidates are pruned by
length, and what cosine the score still asks of the rest, the local threshold, decides whether they
are pruned by coordinates as well: a vector that close to the query must lie near it in the query's
largest coordinates. Products of what is left are computed in full, so results are exact.

A task gets a block of queries and a stripe of buckets, of bounded size both. It takes the buckets in
order of length, what it finds raises the scores asked for, and it returns the best per query and
stripe. A group of equal or equally long vectors is spread over many buckets. Scores are clamped to
what a 64-bit number holds.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowkin.session import stage

BUCKET = 2_048
QUERIES_PER_BLOCK = 512
STRIPE = 64  # buckets that a task meets with a block of queries
LENGTH_STEP = math.log(1.02)
COORDINATE_COSINE = 0.7  # from this local threshold on candidates are pruned by coordinates
FOCUS = 4  # coordinates looked at
SLACK = 1e-9
EXACT = 2.0**53  # integer products below this are exact in doubles

_BLOCK = "ids binary, vectors binary, width int, longest double, members int"
_LONG = 2**63 - 1


def scaled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(vec_id, vector of floor(64 * x) as doubles, its length); vectors with nulls or non-finite parts are left out."""
    for batch in batches:
        ids, vectors, lengths = [], [], []
        for vec_id, x in zip(batch["vec_id"], batch["embedding"], strict=True):
            v = None if x is None else np.asarray(x, dtype=np.float64)
            if v is None or not np.isfinite(v).all():
                continue
            v = np.floor(64 * v)
            if np.isfinite(v).all():
                ids.append(vec_id)
                vectors.append(v)
                lengths.append(float(np.sqrt((v * v).sum())))
        if ids:
            yield pd.DataFrame({"vec_id": ids, "vector": vectors, "length": lengths})


def _packed(keys: list[str], with_floor: bool):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "vec_id"], ascending=[False, True])
        width = max(map(len, group["vector"]))
        matrix = np.zeros((len(group), width))
        for i, v in enumerate(group["vector"]):
            matrix[i, : len(v)] = v
        row = {k: group[k].iloc[0] for k in keys} | {"ids": group["vec_id"].to_numpy(np.int64).tobytes(), "vectors": matrix.tobytes(),
               "width": width, "longest": group["length"].iloc[0], "members": len(group)}
        if with_floor:
            row |= {"floors": group["floor"].fillna(-np.inf).to_numpy(np.float64).tobytes()}
        return pd.DataFrame([row])

    return pack


def _matrix(vectors: bytes, members: int, width: int) -> np.ndarray:
    return np.frombuffer(vectors, np.float64).reshape(members, width)


def _dots(x: np.ndarray, q: np.ndarray, bound: float) -> np.ndarray:
    """Inner products of the rows of ``x`` with ``q``; exact also where doubles would round."""
    if bound < EXACT:
        return x @ q
    big = [[int(v) for v in row] for row in x.tolist()]
    return np.array([sum(a * int(b) for a, b in zip(row, q.tolist(), strict=True)) for row in big], object)


def candidates(unit: np.ndarray, lengths: np.ndarray, q: np.ndarray, q_length: float, floor: float) -> np.ndarray:
    """Places in a bucket, sorted by falling length, that can reach ``floor``. ``unit`` has the directions."""
    n = len(lengths)
    if floor <= 0 or not q_length or not lengths[0]:
        return np.arange(n) if floor <= 0 else np.arange(0)
    if floor / (q_length * lengths[0]) > 1 + SLACK:
        return np.arange(0)
    stop = np.searchsorted(-lengths, -floor / q_length * (1 - SLACK), side="right")
    cosine = np.minimum(floor / (q_length * lengths[:stop]), 1.0)  # what each vector left needs
    if not stop or cosine[0] < COORDINATE_COSINE:
        return np.arange(stop)
    direction = q / q_length
    keep = np.ones(stop, bool)
    for f in np.argsort(-np.abs(direction))[:FOCUS]:
        reach = np.sqrt((1 - cosine**2) * (1 - min(direction[f] ** 2, 1.0))) + 1e-6
        keep &= np.abs(unit[:stop, f] - direction[f] * cosine) <= reach + np.abs(direction[f]) * (1 - cosine)
    return np.flatnonzero(keep)


def _best(k: int):
    def best(asked: pd.DataFrame, stripe: pd.DataFrame) -> pd.DataFrame:
        """The best of a stripe of buckets for one block of queries, longest vectors first; what is found raises the floors."""
        out = []
        if not asked.empty and not stripe.empty:
            a = asked.iloc[0]
            queries, q_ids = _matrix(a.q_vectors, a.q_members, a.q_width), np.frombuffer(a.q_ids, np.int64)
            floors = np.frombuffer(a.floors, np.float64).copy()
            tops: list[list[tuple]] = [[] for _ in q_ids]  # (-score, vec_id), the best k
            for r in stripe.sort_values("longest", ascending=False).itertuples(index=False):
                x, width = _matrix(r.vectors, r.members, r.width), max(r.width, a.q_width)  # a shorter vector has zeros at its end
                x, q = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, queries))
                ids, lengths, q_lengths = np.frombuffer(r.ids, np.int64), np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
                unit = x / np.where(lengths > 0, lengths, 1)[:, None]
                for i in range(len(q)):
                    at = candidates(unit, lengths, q[i], q_lengths[i], floors[i])
                    at = at[ids[at] != q_ids[i]]
                    if not len(at):
                        continue
                    score = _dots(x[at], q[i], q_lengths[i] * r.longest)
                    if len(at) > k:
                        least = np.partition(score, len(at) - k)[len(at) - k]
                        at, score = at[score >= least], score[score >= least]
                    found = zip((-int(s) for s in score.tolist()), ids[at].tolist(), strict=True)
                    tops[i] = heapq.nsmallest(k, [*tops[i], *found])
                    if len(tops[i]) == k:
                        floors[i] = max(floors[i], float(-tops[i][-1][0]))
            out = [(int(q), vec, max(-_LONG, min(_LONG, -minus))) for q, top in zip(q_ids, tops, strict=True) for minus, vec in top]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return best


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def top_products(embeddings: DataFrame, is_query: Column, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` largest inner products with other rows.

    Ties go to the smaller vec_id; a query with fewer candidates has fewer rows. Rows without an id,
    without a vector or with null or non-finite components take no part. Rows that repeat an id count
    as one, with the smallest vector. Vectors of different widths compare as if zeros followed.
    """
    clean = embeddings.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").mapInPandas(
        scaled, "vec_id long, vector array<double>, length double")
    vectors = stage(clean.groupBy("vec_id").agg(F.min(F.struct("vector", "length")).alias("v")).select("vec_id", "v.*"), "vectors")

    cell = F.when(F.col("length") > 0, F.floor(F.log("length") / LENGTH_STEP)).otherwise(-1).cast("int")
    celled = vectors.withColumn("cell", cell)
    blocks = celled.groupBy("cell").agg(F.ceil(F.count("*") / BUCKET).alias("blocks"))
    bucketed = celled.join(F.broadcast(blocks), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    buckets = stage(bucketed.groupBy("cell", "part").applyInPandas(_packed(["cell", "part"], False), f"cell int, part long, {_BLOCK}"), "buckets")

    queries = vectors.where(is_query)
    count = queries.count()
    numbered = stage(queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, math.ceil(count / QUERIES_PER_BLOCK))))), "queries")

    def query_blocks(floors: DataFrame | None) -> DataFrame:
        rows = numbered.withColumn("floor", F.lit(None).cast("double")) if floors is None else numbered.join(floors, "vec_id", "left")
        packed = rows.groupBy("block").applyInPandas(_packed(["block"], True), f"block long, {_BLOCK}, floors binary")
        return packed.select("block", "floors", *[F.col(c).alias(f"q_{c}") for c in ("ids", "vectors", "width", "longest", "members")])

    n_stripes = max(1, math.ceil(buckets.count() / STRIPE))
    # The longest vectors, enough of them for k results: a handful of buckets.
    order = buckets.select("cell", "part", "members", "longest").orderBy(F.desc("longest"), "part").limit(max(8, 2 * k)).collect()
    seeds, seen = [], 0
    for b in order:
        if seen < max(k + 1, BUCKET // 2):
            seeds.append((b["cell"], b["part"]))
            seen += b["members"]
    seed = F.lit(False)
    for c, p in seeds:
        seed = seed | ((F.col("cell") == c) & (F.col("part") == p))

    def met(chosen: DataFrame, blocks: DataFrame, floors: DataFrame | None) -> DataFrame:
        """Results of all pairs of a bucket and a query block, but for pairs whose lengths rule them out."""
        last = F.lit(max(0, math.ceil(count / QUERIES_PER_BLOCK) - 1))
        pairs = chosen.select("cell", "part", "longest", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))).alias("block"))
        if floors is not None:
            reach = numbered.join(floors, "vec_id", "left").groupBy("block").agg(
                F.min(F.coalesce(F.col("floor"), F.lit(float("-inf"))) / F.greatest("length", F.lit(1e-300))).alias("needs"))
            pairs = pairs.join(reach, "block").where((F.col("needs") <= 0) | (F.col("longest") * (1 + SLACK) >= F.col("needs")))
        stripes = pairs.select("cell", "part", "block", F.pmod(F.xxhash64("cell", "part"), F.lit(n_stripes)).alias("stripe"))
        met_by = stripes.join(chosen, ["cell", "part"]).groupBy("block", "stripe")
        asked = blocks.join(stripes.select(F.col("block").alias("of"), F.col("stripe").alias("number")).distinct(), F.col("block") == F.col("of"))
        return asked.groupBy("of", "number").cogroup(met_by).applyInPandas(_best(k), "query_id long, vec_id long, score long")

    if not count:
        return _nothing(vectors)
    first = stage(met(buckets.where(seed), stage(query_blocks(None), "query-blocks"), None), "first")
    floors = stage(_ranked(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor")), "floors")
    second = met(buckets.where(~seed), stage(query_blocks(floors), "query-blocks"), floors)
    return _ranked(first.unionByName(second), k).select("query_id", "rank", "vec_id", "score")


def _nothing(like: DataFrame) -> DataFrame:
    return like.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("bigint").alias("score"))
