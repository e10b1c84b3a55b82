"""The registered queries of the operators, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowkin.llm import bpe, fixity, interpolation, langid, mixing, neardup, phrases, repetition, runs, sharding, topk, transducer, urltree
from rowkin.llm.tables import WORD, given, remainder

CONTEXT = 2048  # tokens
SHARDS = [f"shard-{i:02d}" for i in range(32)]


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """The shard of every document."""
    placed = sharding.place(given(spark, folder, "documents").select("doc_id"), "doc_id", sharding.slot_table(spark, SHARDS))
    return placed.select("doc_id", "slot", "shard")


_SLOTS = sharding.prime_from(sharding.SLOTS_PER_SHARD * len(SHARDS))
_HASHED = "('0x' || substr(md5({}), 1, 15))::BIGINT % {}"
OP1_SQL = f"""
WITH RECURSIVE shards AS (
  SELECT s, printf('shard-%02d', s) AS shard, {_HASHED.format("printf('shard-%02d', s) || '#offset'", _SLOTS)} AS start,
         {_HASHED.format("printf('shard-%02d', s) || '#skip'", _SLOTS - 1)} + 1 AS skip
  FROM range({len(SHARDS)}) AS t(s)),
fill AS (
  SELECT 0 AS turn, list_transform(range({_SLOTS}), lambda x: -1) AS owners
  UNION ALL
  SELECT turn + 1, owners[1:slot] || [s::INTEGER] || owners[slot + 2:]
  FROM (SELECT turn, owners, s, list_filter(list_transform(range({_SLOTS}), lambda j: (start + j * skip) % {_SLOTS}),
               lambda p: owners[p + 1] = -1)[1] AS slot
        FROM fill JOIN shards ON s = turn % {len(SHARDS)} WHERE turn < {_SLOTS})),
slots AS (
  SELECT unnest(range({_SLOTS})) AS slot, unnest(owners) AS s FROM fill WHERE turn = {_SLOTS})
SELECT doc_id, slot::INTEGER AS slot, shard
FROM (SELECT doc_id, {_HASHED.format("coalesce(doc_id::VARCHAR, '')", _SLOTS)} AS cell FROM documents) AS d
JOIN slots ON slot = cell JOIN shards USING (s)"""


def op2_fixity(spark: SparkSession, folder: str) -> DataFrame:
    """Two replicas of all pages as WARC records, each hashed and laid out from its own bytes.

    In the second, some records have other letters in place. In every third archive some are cut
    to half and some are lost, so that what follows them moves.
    """
    pages = given(spark, folder, "pages").select("page_id", "url", "html")
    number, hit = F.col("page_id"), F.floor(F.col("page_id") / fixity.PAGES_PER_ARCHIVE) % 3 == 0
    html = F.when(hit & (number % 307 == 11), F.expr("left(html, cast(length(html) / 2 as int))")).when(
        number % 101 == 7, F.translate("html", "e", "3")).otherwise(F.col("html"))
    kept = ~F.coalesce(hit & (number % 211 == 5), F.lit(False))
    return fixity.audit(fixity.page_records(pages), fixity.page_records(pages.where(kept).withColumn("html", html)))


def _tree_sql(source: str, levels: int) -> str:
    """The root of each archive as nested aggregates, for archives of up to 16 ** levels ranges."""
    sql = (f"SELECT archive, \"offset\" // {fixity.RANGE_BYTES} AS node, sha256(string_agg(\"offset\" || ':' || content, chr(10) ORDER BY \"offset\", content)) AS hash "
           f"FROM {source} GROUP BY ALL")
    for _ in range(levels):
        sql = (f"SELECT archive, node // {fixity.FANOUT} AS node, sha256(string_agg(node || ':' || hash, '' ORDER BY node)) AS hash "
               f"FROM ({sql}) GROUP BY archive, node // {fixity.FANOUT}")
    return sql


def _records_sql(pages: str) -> str:
    return f"""SELECT *, coalesce(sum(length) OVER (PARTITION BY archive ORDER BY record_id NULLS FIRST, digest
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", coalesce(record_id::VARCHAR, '') || ':' || length || ':' || digest AS content
FROM (SELECT coalesce((page_id // {fixity.PAGES_PER_ARCHIVE})::VARCHAR, 'none') AS archive, page_id AS record_id,
  strlen(record)::BIGINT AS length, sha256(record) AS digest FROM (
  SELECT page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
    || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || repeat(chr(13) || chr(10), 2) || coalesce(html, '')
    || repeat(chr(13) || chr(10), 2) AS record FROM {pages}))"""


def op2_sql(levels: int) -> str:
    return f"""
WITH original AS MATERIALIZED ({_records_sql('pages')}),
second AS (SELECT page_id, url, CASE WHEN hit AND page_id % 307 = 11 THEN left(html, (length(html) // 2)::INT)
  WHEN page_id % 101 = 7 THEN translate(html, 'e', '3') ELSE html END AS html
  FROM (SELECT *, coalesce((page_id // {fixity.PAGES_PER_ARCHIVE}) % 3 = 0, false) AS hit FROM pages) WHERE NOT hit OR page_id % 211 <> 5),
copy AS MATERIALIZED ({_records_sql('second')}),
roots AS (SELECT archive, l.hash AS left_root, r.hash AS right_root
  FROM ({_tree_sql('original', levels)}) AS l FULL JOIN ({_tree_sql('copy', levels)}) AS r USING (archive)),
lone AS MATERIALIZED (SELECT archive, "offset", length, record_id, content, min(side) AS side
  FROM (SELECT 'left' AS side, * FROM original UNION ALL SELECT 'right', * FROM copy)
  GROUP BY archive, "offset", length, record_id, content HAVING count(DISTINCT side) = 1),
matched AS MATERIALIZED (SELECT *, EXISTS (SELECT 1 FROM lone AS o WHERE o.side <> l.side AND o.archive = l.archive AND o.content = l.content) AS moved FROM lone AS l),
rest AS MATERIALIZED (SELECT * FROM matched WHERE NOT moved),
seen AS (SELECT *, EXISTS (SELECT 1 FROM rest AS o WHERE o.side <> l.side AND o.archive = l.archive AND o."offset" = l."offset") AS same_place,
  EXISTS (SELECT 1 FROM rest AS o WHERE o.side <> l.side AND o.archive = l.archive AND o.record_id = l.record_id) AS same_id FROM rest AS l),
odd AS (SELECT archive, 'moved' AS verdict, "offset", record_id, length FROM matched WHERE moved AND side = 'left'
  UNION ALL SELECT archive, CASE WHEN side = 'right' THEN 'extra' WHEN same_place OR same_id THEN 'altered' ELSE 'missing' END, "offset", record_id, length
  FROM seen WHERE side = 'left' OR NOT (same_place OR same_id))
SELECT archive, left_root, right_root, verdict, "offset", record_id, length FROM roots JOIN odd USING (archive)
UNION ALL
SELECT archive, left_root, right_root, 'intact', NULL, NULL, NULL FROM roots WHERE left_root = right_root"""


OP2_SQL = op2_sql(fixity.MIN_LEVELS)

def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids and decoded text of every document, as digests."""
    return bpe.digests(bpe.encode(given(spark, folder, "documents"), vocabulary()))


def op4_interpolation(spark: SparkSession, folder: str) -> DataFrame:
    """The language-model score of every document; a seventh is held out, a seventh gives the weights."""
    return interpolation.score(given(spark, folder, "documents"), remainder("doc_id", 7) == 2, remainder("doc_id", 7) == 3)


def op5_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 largest inner products of every twentieth vector with all others."""
    return topk.top_products(given(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, 20)


OP5_SQL = """
WITH clean AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM clean AS q JOIN clean AS c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 20"""


def op6_neardup(spark: SparkSession, folder: str) -> DataFrame:
    """The near-duplicate group of every document."""
    return neardup.near_duplicates(given(spark, folder, "documents"))


OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM items AS a JOIN items AS b USING (shingle) WHERE a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.y FROM reached AS r JOIN links AS l ON l.x = r.other)
SELECT doc_id, len(s)::BIGINT AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM sets JOIN reached USING (doc_id) GROUP BY doc_id, s"""


def op7_langid(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document; a quarter of the documents is held out from learning."""
    return langid.identify(given(spark, folder, "documents"), remainder("doc_id", 4) == 2)


def op8_repetition(spark: SparkSession, folder: str) -> DataFrame:
    """The repetition verdict on every document."""
    return repetition.judge(given(spark, folder, "documents"))


# The given rules.
URL_RULES = (urltree.Rule("block", "net", "/"), urltree.Rule("allow", "example.net", "/en/"),
             urltree.Rule("block", "example.com", "/de/"), urltree.Rule("allow", "org", "/fr/"))
MIX_TARGETS = {"clean": 0.85, "toxic": 0.01, "poor": 0.14}


def op9_urltree(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict on every page's url; pages are labelled by the labels of their number."""
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    labels = given(spark, folder, "labels").select(F.col("doc_id").alias("page_id"), good.alias("good"))
    return urltree.judge(given(spark, folder, "pages").select("page_id", "url"), labels, URL_RULES)


def domain_labels(labels: DataFrame) -> DataFrame:
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain"))


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Rate and memberships of every document for the target weights."""
    return mixing.mix(given(spark, folder, "documents"), domain_labels(given(spark, folder, "labels")), MIX_TARGETS, words=True)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the texts repeat some of their words up to the end; a null id counts as empty text."""
    hashed = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    # Positions fit an int: a text has fewer words than bytes.
    planted = F.expr("""array_join(transform(words, (w, i) -> if(i < a, w, words[a + (i - a) % p])), ' ')""")
    marked = docs.select("doc_id", "text", (hashed % 10 == 0).alias("planted"), F.floor(hashed / 10).alias("g"))
    split = marked.withColumn("words", F.when(F.col("planted"), words)).withColumn("n", F.size("words"))
    split = split.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    split = split.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    return split.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op11_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The periodic runs of every document, some of which are planted, and the digest of the text without their repeats."""
    found = runs.find_runs(with_planted_runs(given(spark, folder, "documents")))
    longest = F.element_at(F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], F.when(x["length"] > y["length"], -1).otherwise(1))
                                        .when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1))
                                        .when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0)), 1)
    best = F.when(F.size("runs") > 0, longest)
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The 2,000 strongest phrases of every language."""
    return phrases.collocations(given(spark, folder, "documents"), 2_000)


OP12_SQL = r"""
WITH pieces AS (
  SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM (
    SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
split AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
words AS (SELECT lang, piece, unnest(w) AS w1, generate_subscripts(w, 1) AS pos FROM split),
suffixes AS (SELECT lang, w1, lead(w1, 1) OVER p AS w2, lead(w1, 2) OVER p AS w3 FROM words WINDOW p AS (PARTITION BY piece ORDER BY pos)),
one AS (SELECT lang, w1, count(*) AS f FROM suffixes GROUP BY ALL),
two AS (SELECT lang, w1, w2, count(*) AS f FROM suffixes WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
three AS (SELECT lang, w1, w2, w3, count(*) AS f FROM suffixes WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
longer AS (
  SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM three UNION ALL SELECT lang, w2, w3, f FROM three) GROUP BY ALL),
cuts AS (
  SELECT lang, w1 || ' ' || w2 AS phrase, two.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM two JOIN one AS x USING (lang, w1) JOIN one AS y ON y.lang = two.lang AND y.w1 = two.w2 LEFT JOIN longer USING (lang, w1, w2)
  WHERE longer.f IS NULL OR 100 * longer.f < 50 * two.f
  UNION ALL
  SELECT three.lang, three.w1 || ' ' || three.w2 || ' ' || w3, three.f, 1, x.f, y.f
  FROM three JOIN one AS x ON x.lang = three.lang AND x.w1 = three.w1 JOIN two AS y ON y.lang = three.lang AND y.w1 = three.w2 AND y.w2 = three.w3
  UNION ALL
  SELECT three.lang, three.w1 || ' ' || three.w2 || ' ' || w3, three.f, 2, x.f, y.f
  FROM three JOIN two AS x ON x.lang = three.lang AND x.w1 = three.w1 AND x.w2 = three.w2 JOIN one AS y ON y.lang = three.lang AND y.w1 = three.w3),
scored AS (SELECT *, (1000000 * a::HUGEINT * a::HUGEINT // (l::HUGEINT * r::HUGEINT))::BIGINT AS score FROM cuts),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score
FROM best JOIN (SELECT lang, sum(f) AS n FROM one GROUP BY lang) USING (lang) QUALIFY rank <= 2000"""


def op13_transducer(spark: SparkSession, folder: str) -> DataFrame:
    """The number of tokens of every document."""
    counted = transducer.count_tokens(given(spark, folder, "documents"), vocabulary())
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > CONTEXT).alias("over_limit"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_fixity": op2_fixity,
    "op3_bpe": op3_bpe,
    "op4_interpolation": op4_interpolation,
    "op5_topk": op5_topk,
    "op6_neardup": op6_neardup,
    "op7_langid": op7_langid,
    "op8_repetition": op8_repetition,
    "op9_urltree": op9_urltree,
    "op10_mixing": op10_mixing,
    "op11_runs": op11_runs,
    "op12_phrases": op12_phrases,
    "op13_transducer": op13_transducer,
}

ORACLE: dict[str, str] = {"op1_sharding": OP1_SQL, "op2_fixity": OP2_SQL, "op5_topk": OP5_SQL, "op6_neardup": OP6_SQL,
                          "op12_phrases": OP12_SQL}


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}
