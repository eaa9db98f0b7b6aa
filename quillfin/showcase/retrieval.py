"""Scoring and ranking: points of four vectors each from ``embeddings``, texts from ``documents``.

Queries over the vector points are pooled per label: the mean, maximum and minimum vector of the
label's rows are the three query tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfin.models.embed import HashEmbedder, embed
from quillfin.operators import chunking, maxsim, points, pruning, rerank
from quillfin.session import spread
from quillfin.showcase import Showcase, table
from quillfin.showcase.files import CHUNK_SQL
from quillfin.showcase.store import scratch, stored_live

shown = Showcase()
add = shown.add


def _pad(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), 9, "0"))


def vector_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of four consecutive vectors; two points (text, image) make a chunk."""
    number = F.floor(F.col("vec_id") / 4)
    rows = table(spark, sf_dir, "embeddings").select(number.alias("point"), "vec_id", "embedding", "label")
    gathered = F.sort_array(F.collect_list(F.struct("vec_id", "embedding")))
    return rows.groupBy("point").agg(
        F.transform(gathered, lambda s: s["embedding"]).alias("vectors"), F.min_by("label", "vec_id").alias("label")
    ).select(
        _pad("pt", F.col("point")).alias("segment_id"),
        _pad("ch", F.floor(F.col("point") / 2)).alias("chunk_id"),
        F.when(F.col("point") % 2 == 0, "text").otherwise("image").alias("modality"),
        F.concat(F.lit("/shelf/"), F.col("label")).alias("path"),
        F.lit(1).cast("long").alias("version"),
        "vectors",
    )


def label_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    x = F.col("x").cast("double")
    pooled = cells.groupBy("label", "pos").agg(F.avg(x).alias("a"), F.max(x).alias("b"), F.min(x).alias("c"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "a", "b", "c")))
    return pooled.groupBy("label").agg(ordered.alias("cells")).select(
        F.col("label").cast("string").alias("query_id"),
        F.array("cells.a", "cells.b", "cells.c").alias("vectors"),
    )


_VECTOR_SQL = """
cell AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
pool AS (SELECT label, pos, avg(x) AS a, max(x) AS b, min(x) AS c FROM cell GROUP BY label, pos),
qt AS (SELECT CAST(label AS VARCHAR) AS query_id, 0 AS qi, list(a ORDER BY pos) AS qv FROM pool GROUP BY label
  UNION ALL SELECT CAST(label AS VARCHAR), 1, list(b ORDER BY pos) FROM pool GROUP BY label
  UNION ALL SELECT CAST(label AS VARCHAR), 2, list(c ORDER BY pos) FROM pool GROUP BY label),
tok AS (SELECT vec_id, label, vec_id // 4 AS point, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pt AS (SELECT point, 'pt' || lpad(CAST(point AS VARCHAR), 9, '0') AS segment_id, 'ch' || lpad(CAST(point // 2 AS VARCHAR), 9, '0') AS chunk_id,
  CASE WHEN point % 2 = 0 THEN 'text' ELSE 'image' END AS modality, '/shelf/' || min_by(label, vec_id) AS path,
  avg(v[1]) AS first_mean, min_by(v, vec_id) AS v0 FROM tok GROUP BY point),
best AS (SELECT query_id, qi, point, max(list_inner_product(qv, v)) AS b FROM qt, tok GROUP BY ALL),
sc AS (SELECT query_id, segment_id, chunk_id, modality, path, first_mean, v0, round(sum(b), 6) AS score
  FROM best JOIN pt USING (point) GROUP BY ALL)
"""
_ROLLED = """rolled AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, segment_id) AS rn FROM sc) WHERE rn = 1)"""
_TOP = "SELECT query_id, CAST(rank AS INTEGER) AS rank, segment_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, segment_id) AS rank FROM {src}) WHERE rank <= {k}"


@add(f"""WITH {_VECTOR_SQL}
SELECT query_id, doc_id, round(sum(b), 6) AS score FROM (
  SELECT query_id, qi, CAST(label AS VARCHAR) AS doc_id, max(list_inner_product(qv, v)) AS b FROM qt, tok GROUP BY ALL)
GROUP BY query_id, doc_id""")
def maxsim_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("doc_id"), F.col("embedding").alias("v")
    )
    return maxsim.maxsim_scores(tokens, label_queries(spark, sf_dir))


@add(f"WITH {_VECTOR_SQL} {_TOP.format(src='sc', k=10)}")
def maxsim_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxsim.maxsim_topk(vector_points(spark, sf_dir), label_queries(spark, sf_dir), 10)


@add(f"WITH {_VECTOR_SQL} {_TOP.format(src='sc', k=10)}")
def maxsim_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows from a table in blocks, of which only those are scored that can reach the tenth best."""
    stored = pruning.write_blocks(vector_points(spark, sf_dir), scratch(spark, "blocks"))
    return pruning.pruned_topk(stored, label_queries(spark, sf_dir), 10).result


@add(f"WITH {_VECTOR_SQL}, {_ROLLED} {_TOP.format(src='rolled', k=10)}")
def rollup_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best chunks by their best point, with the same blocks left out."""
    stored = pruning.write_blocks(vector_points(spark, sf_dir), scratch(spark, "blocks"))
    return pruning.pruned_topk(stored, label_queries(spark, sf_dir), 10, group="chunk_id").result


@add(f"""WITH {_VECTOR_SQL},
sizes AS (SELECT path, count(*) AS n FROM pt GROUP BY path),
kept AS (SELECT * FROM sc WHERE path IN (SELECT path FROM sizes WHERE n >= (SELECT avg(n) FROM sizes)))
{_TOP.format(src='kept', k=10)}""")
def maxsim_path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = vector_points(spark, sf_dir)
    sizes = pts.groupBy("path").agg(F.count("*").alias("n"))
    mean = sizes.agg(F.avg("n").alias("mean"))
    allowed = sizes.join(F.broadcast(mean), F.col("n") >= F.col("mean")).select("path")
    return maxsim.maxsim_topk(points.in_paths(pts, allowed), label_queries(spark, sf_dir), 10)


@add(f"""WITH {_VECTOR_SQL}, kept AS (SELECT * FROM sc WHERE NOT first_mean < 0) {_TOP.format(src='kept', k=10)}""")
def maxsim_soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = vector_points(spark, sf_dir)
    mean = F.aggregate("vectors", F.lit(0.0), lambda a, v: a + F.get(v, F.lit(0)).cast("double"))
    dead = pts.where(mean < 0).select("segment_id", F.lit(2).cast("long").alias("version"))
    return maxsim.maxsim_topk(stored_live(spark, pts, dead), label_queries(spark, sf_dir), 10)


@add(f"WITH {_VECTOR_SQL}, {_ROLLED} {_TOP.format(src='rolled', k=10)}")
def rollup_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxsim.maxsim_topk(vector_points(spark, sf_dir), label_queries(spark, sf_dir), 10, group="chunk_id")


@add(f"""WITH {_VECTOR_SQL}, top AS ({_TOP.format(src='sc', k=10)}),
dd AS (SELECT t.*, p.chunk_id, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY rank) AS rn FROM top t JOIN pt p USING (segment_id))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS rank, segment_id, chunk_id, score FROM dd WHERE rn = 1""")
def rollup_after_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cut-then-deduplicate order, which may return fewer than k chunks."""
    pts = vector_points(spark, sf_dir)
    top = maxsim.maxsim_topk(pts, label_queries(spark, sf_dir), 10)
    named = top.join(pts.select("segment_id", "chunk_id"), "segment_id")
    kept = points.best_per_group(named, ["query_id"], F.col("chunk_id")).drop("rank")
    return points.ranked(kept, ["query_id"], [F.desc("score"), F.col("segment_id")], 10).select(
        "query_id", "rank", "segment_id", "chunk_id", "score"
    )


@add(f"""WITH {_VECTOR_SQL}, {_ROLLED}, pool30 AS ({_TOP.format(src='rolled', k=30)}),
cand AS (SELECT p.*, sc.path, sc.v0 FROM pool30 p JOIN sc USING (query_id, segment_id)),
ranks AS (SELECT query_id, segment_id, CAST(floor(abs(v0[1]) * 100) AS INTEGER) % 7 AS r, round(v0[2], 3) AS s FROM cand
  WHERE path <> '/shelf/' || query_id AND rank <= 12),
j AS (SELECT c.*, k.segment_id IS NOT NULL AS placed, CASE WHEN k.r = 0 THEN 999 ELSE k.r END AS nr, k.s, CASE WHEN k.segment_id IS NOT NULL THEN 'r' || k.r END AS reason
  FROM cand c LEFT JOIN ranks k USING (query_id, segment_id))
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY placed DESC, nr, -s, rank) AS INTEGER) AS rank,
  segment_id, score, reason AS rerank_reason FROM j) WHERE rank <= 10""")
def rerank_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oversample by three, move the candidates a reranker placed, cut to ten."""
    pts = vector_points(spark, sf_dir)
    pool = maxsim.maxsim_topk(pts, label_queries(spark, sf_dir), 30, group="chunk_id")
    first = F.get(F.col("vectors"), F.lit(0))
    features = pts.select(
        "segment_id", "path", F.get(first, F.lit(0)).cast("double").alias("x1"), F.get(first, F.lit(1)).cast("double").alias("x2")
    )
    seen = pool.join(features, "segment_id")
    rank = F.floor(F.abs("x1") * 100).cast("int") % 7
    ranks = seen.where(F.col("path") != F.concat(F.lit("/shelf/"), "query_id")).select(
        "query_id",
        (F.col("rank") - 1).alias("id"),
        rank.alias("rank"),
        F.round("x2", 3).alias("score"),
        F.concat(F.lit("r"), rank).alias("reason"),
        (F.col("rank") - 1).alias("ord"),
    )
    return rerank.merge_ranks(pool, ranks, max_candidates=12).where("rank <= 10")


# ---- text search --------------------------------------------------------------------------------


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    chunks = chunking.boundary_chunks(docs, "text")
    return chunks.select(
        F.concat(_pad("d", F.col("doc_id")), _pad("#", F.col("chunk_no"))).alias("segment_id"),
        _pad("d", F.col("doc_id")).alias("doc"),
        F.col("chunk_text").alias("text"),
    )


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")
    return embed(items, "text", HashEmbedder(), as_query=True)


def _word_vectors(words: str) -> str:
    """SQL for (w, v): unit vectors of the MD5 hex digits of the distinct words of a relation."""
    return f"""SELECT w, list_transform(d, lambda x: CAST(CAST(x / norm AS FLOAT) AS DOUBLE)) AS v FROM
  (SELECT w, d, sqrt(list_sum(list_transform(d, lambda x: x * x))) AS norm FROM
    (SELECT w, list_transform(string_split(md5(w), ''), lambda c: strpos('0123456789abcdef', c) - 8.5) AS d FROM (SELECT DISTINCT w FROM {words})))"""


_TEXT_SQL = rf"""
qw AS (SELECT CAST(item_id AS VARCHAR) AS query_id, w, count(*) AS uses FROM
  (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS w FROM benchmark) GROUP BY ALL),
chunk AS (SELECT 'd' || lpad(CAST(s.doc_id AS VARCHAR), 9, '0') AS doc, 'd' || lpad(CAST(s.doc_id AS VARCHAR), 9, '0') || '#' || lpad(CAST(chunk_no AS VARCHAR), 9, '0') AS segment_id,
  substr(text, pos + 1, cut - pos) AS body FROM spans s JOIN documents USING (doc_id)),
dw AS MATERIALIZED (SELECT DISTINCT segment_id, w FROM (SELECT segment_id, unnest(regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}]+')) AS w FROM chunk)),
vq AS MATERIALIZED (SELECT w, row_number() OVER () AS wi, CAST(v AS DOUBLE[32]) AS v FROM ({_word_vectors('qw')})),
vd AS MATERIALIZED (SELECT w, row_number() OVER () AS wi, CAST(v AS DOUBLE[32]) AS v FROM ({_word_vectors('dw')})),
seg AS MATERIALIZED (SELECT segment_id, row_number() OVER () AS si FROM (SELECT DISTINCT segment_id FROM dw)),
di AS (SELECT si, vd.wi AS di FROM dw JOIN vd USING (w) JOIN seg USING (segment_id)),
qi AS (SELECT query_id, vq.wi AS qi, uses FROM qw JOIN vq USING (w)),
sim AS (SELECT vq.wi AS qi, vd.wi AS di, array_inner_product(vq.v, vd.v) AS s FROM vq, vd),
mi AS MATERIALIZED (SELECT si, qi, max(s) AS s FROM di JOIN sim USING (di) GROUP BY si, qi),
sc AS (SELECT query_id, segment_id, round(score, 6) AS score FROM
  (SELECT query_id, si, sum(s * uses) AS score FROM mi JOIN qi USING (qi) GROUP BY query_id, si) JOIN seg USING (si))
"""


TEXT_SEARCH_SQL = f"WITH RECURSIVE {CHUNK_SQL}, {_TEXT_SQL} {_TOP.format(src='sc', k=10)}"


@add(TEXT_SEARCH_SQL)
def text_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents cut into chunks, embedded, and scored for every benchmark text: best ten chunks."""
    return maxsim.maxsim_topk(text_chunks(spark, sf_dir), text_queries(spark, sf_dir), 10, text_model=HashEmbedder())


@add(f"""WITH RECURSIVE {CHUNK_SQL}, {_TEXT_SQL},
rolled AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, substr(segment_id, 1, 10) ORDER BY score DESC, segment_id) AS rn FROM sc) WHERE rn = 1)
{_TOP.format(src='rolled', k=10)}""")
def text_search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search rolled up to the best chunk per document."""
    return maxsim.maxsim_topk(text_chunks(spark, sf_dir), text_queries(spark, sf_dir), 10, group="doc", text_model=HashEmbedder())


@add(rf"""WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS ws FROM conversations),
u AS (SELECT conv_id, turn, unnest(ws) AS w FROM w),
vw AS ({_word_vectors('u')}),
v AS (SELECT conv_id, turn, v FROM u JOIN vw USING (w))
SELECT conv_id, turn, count(*) AS n_tokens, round(sum(list_sum(v)), 4) AS component_sum, round(sum(v[7] * v[32]), 4) AS cross_sum
FROM v GROUP BY conv_id, turn""")
def hash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    tokens = embed(texts, "text", HashEmbedder()).select("conv_id", "turn", F.explode("vectors").alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double"))
    cross = F.get(F.col("v"), F.lit(6)).cast("double") * F.get(F.col("v"), F.lit(31)).cast("double")
    return tokens.groupBy("conv_id", "turn").agg(
        F.count("*").alias("n_tokens"),
        F.round(F.sum(total), 4).alias("component_sum"),
        F.round(F.sum(cross), 4).alias("cross_sum"),
    )


# ---- store semantics ----------------------------------------------------------------------------


@add("""
SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value,
  arg_max(props, event_id) AS props FROM events GROUP BY user_id""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "props")
    return points.latest(rows, "user_id", "event_id")


@add("""
WITH last AS (SELECT user_id, event_type, max(event_id) AS version, arg_max(value, event_id) AS value FROM events GROUP BY ALL),
gone AS (SELECT user_id, max(event_id) AS gone_at FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT l.event_type, count(*) AS points_count FROM last l LEFT JOIN gone g USING (user_id)
WHERE g.gone_at IS NULL OR g.gone_at <= l.version GROUP BY l.event_type""")
def points_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points are (user, type) keys; an error deletes what the user had before it, later events revive it."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    keyed = events.withColumn("segment_id", F.concat_ws("|", "user_id", "event_type"))
    stored = points.latest(keyed, "segment_id", "event_id").withColumnRenamed("event_id", "version")
    gone = events.where("event_type = 'error'").select("user_id", F.col("event_id").alias("version"))
    return points.live(stored, gone, key="user_id").groupBy("event_type").agg(F.count("*").alias("points_count"))
