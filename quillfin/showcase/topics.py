"""Topics and points. Files are users, pages are hours, topics are event types (hours have holes and
may carry several topics); for bodies, files are conversations, pages are turns, topics are roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfin.functions import jsonx
from quillfin.operators import points, rerank, topics
from quillfin.operators.running import Running, key_blocks, running
from quillfin.session import spread
from quillfin.showcase import Showcase, table

shown = Showcase()
add = shown.add

COLD, CAP = 24, 3

_ASSIGN_SQL = """
a AS (SELECT CAST(user_id AS VARCHAR) AS path, CAST(date_diff('hour', TIMESTAMP '2024-01-01', ts) + 1 AS INTEGER) AS page, event_id AS ord,
  event_type AS topic_id, CASE WHEN value < 5 THEN '' ELSE event_type || ' ' || value END AS title, props AS summary, value > 20 AS cont FROM events)
"""
_SESSION_SQL = f"""{_ASSIGN_SQL},
tp AS (SELECT path, topic_id, page, min(ord) AS ord, arg_min(title, ord) AS title, arg_min(summary, ord) AS summary FROM a GROUP BY ALL),
pg AS (SELECT path, page, lag(page) OVER (PARTITION BY path ORDER BY page) AS newest FROM (SELECT DISTINCT path, page FROM a)),
lg AS (SELECT *, lag(page) OVER (PARTITION BY path, topic_id ORDER BY page) AS last_page FROM tp JOIN pg USING (path, page)),
ss AS (SELECT *, sum(CASE WHEN last_page IS NULL OR newest - last_page >= {COLD} THEN 1 ELSE 0 END) OVER (PARTITION BY path, topic_id ORDER BY page) AS session FROM lg),
st AS (SELECT *, CAST((row_number() OVER (PARTITION BY path, topic_id, session ORDER BY page) - 1) // {CAP} AS INTEGER) AS part FROM ss)
"""


def hour_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00"))) / 3600)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("path"),
        (hours + 1).cast("int").alias("page"),
        F.col("event_id").alias("ord"),
        F.col("event_type").alias("topic_id"),
        (F.col("value") > 20).alias("is_continuation"),
        F.when(F.col("value") < 5, "").otherwise(F.concat_ws(" ", "event_type", "value")).alias("title"),
        F.col("props").alias("summary"),
    )


@add(f"WITH {_SESSION_SQL} SELECT path, topic_id, page, CAST(session AS BIGINT) AS session, part FROM st")
def topic_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topics.topic_sessions(hour_assignments(spark, sf_dir), COLD, CAP, block=64)
    return rows.select("path", "topic_id", "page", "session", "part")


@add(f"""WITH {_SESSION_SQL},
f AS (SELECT path, topic_id, session, part, arg_min(title, page) AS t, arg_min(summary, page) AS s, min(page) AS hero_page,
  string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS pages FROM st GROUP BY ALL),
g AS (SELECT *, CASE WHEN t = '' THEN 'Topic starting on p.' || hero_page ELSE t END AS title FROM f)
SELECT path, topic_id, CAST(session AS BIGINT) AS session, part, title, s AS summary, pages, hero_page,
  title || chr(10) || s AS excerpt FROM g""")
def topic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = topics.topic_chunks(topics.topic_sessions(hour_assignments(spark, sf_dir), COLD, CAP, block=64))
    return chunks.select(
        "path", "topic_id", "session", "part", "title", "summary",
        F.array_join("page_refs", ",").alias("pages"), "hero_page", "excerpt",
    )


@add(f"""WITH {_SESSION_SQL},
i AS (SELECT *, page - row_number() OVER (PARTITION BY path, topic_id, session, part ORDER BY page) AS island FROM st),
r AS (SELECT path, topic_id, session, part, min(page) AS a, max(page) AS b FROM i GROUP BY path, topic_id, session, part, island)
SELECT path, topic_id, CAST(session AS BIGINT) AS session, part,
  string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '–' || b END, ', ' ORDER BY a) AS label,
  substr(string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a), 1, 12) AS short_label
FROM r GROUP BY path, topic_id, session, part""")
def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = topics.topic_chunks(topics.topic_sessions(hour_assignments(spark, sf_dir), COLD, CAP, block=64))
    return chunks.select(
        "path", "topic_id", "session", "part",
        topics.page_label(F.col("page_refs")).alias("label"),
        topics.page_label(F.col("page_refs"), "-", 12).alias("short_label"),
    )


@add("""SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS page,
  CAST(sum(CAST(value AS DECIMAL(18, 4))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS value_so_far FROM events""")
def numbered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row numbers and running sums per user, however many events one user has."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.col("value").cast("decimal(18,4)").alias("v"))
    counted = running(
        events, ["user_id"], [F.col("ts"), F.col("event_id")], key_blocks(events, ["user_id"], F.date_trunc("hour", "ts")),
        [Running("page", "count", F.lit(1)), Running("value_so_far", "sum", F.col("v"))],
    )
    return counted.select("event_id", "user_id", "page", F.col("value_so_far").cast("double").alias("value_so_far"))


@add(f"""WITH {_ASSIGN_SQL},
n AS (SELECT path, page, (row_number() OVER (PARTITION BY path ORDER BY page) - 1) // 3 AS window_no FROM (SELECT DISTINCT path, page FROM a)),
ok AS (SELECT DISTINCT path, window_no FROM n JOIN (SELECT DISTINCT path, page FROM a WHERE topic_id IN ('purchase', 'error')) USING (path, page))
SELECT path, page, 'unparsed_' || window_no AS topic_id, 'Unparsed window (pages ' || min(page) OVER w || '–' || max(page) OVER w || ')' AS title
FROM n WHERE (path, window_no) NOT IN (SELECT (path, window_no) FROM ok) WINDOW w AS (PARTITION BY path, window_no)""")
def unparsed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hour_assignments(spark, sf_dir)
    parsed = rows.where(F.col("topic_id").isin("purchase", "error"))
    return topics.unparsed_windows(rows, parsed, 3, block=64).select("path", "page", "topic_id", "title")


# ---- bodies and points --------------------------------------------------------------------------

_BODY_SQL = """
seg AS (SELECT conv_id, CAST(turn AS INTEGER) + 1 AS page, role, i AS ord, string_split(text, chr(10))[i] AS line
  FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM conversations)),
pt AS (SELECT conv_id, page, role, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY ord) FILTER (line <> ''), ''), '^\\s+|\\s+$', '', 'g') AS page_text
  FROM seg GROUP BY ALL),
ch AS (SELECT conv_id, role, (row_number() OVER (PARTITION BY conv_id, role ORDER BY page) - 1) // 2 AS part, page, page_text FROM pt),
body AS (SELECT conv_id, role, CAST(part AS INTEGER) AS part, min(page) AS hero_page, count(*) AS n_pages,
  role || chr(10) || 'c' || conv_id || coalesce(chr(10) || chr(10) || string_agg('[page ' || page || ']' || chr(10) || page_text, chr(10) || chr(10) ORDER BY page) FILTER (page_text <> ''), '') AS body
  FROM ch GROUP BY conv_id, role, part),
kinds AS (SELECT *, 'c' || conv_id || '|' || role || '|' || part AS chunk_id,
  CASE role WHEN 'user' THEN 'pdf_topic' WHEN 'system' THEN 'image' ELSE 'text_topic' END AS kind FROM body)
"""


def conversation_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of up to two turns of one role, with page texts gathered in page order."""
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("path"), (F.col("turn") + 1).cast("int").alias("page"), "role", "text"
    )
    lines = turns.select("path", "page", "role", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    texts = points.page_text(lines, ["path"])
    assignments = turns.select(
        "path", "page", F.lit(0).alias("ord"), F.col("role").alias("topic_id"), F.lit(False).alias("is_continuation"),
        F.col("role").alias("title"), F.concat(F.lit("c"), "path").alias("summary"),
    )
    chunks = topics.topic_chunks(topics.topic_sessions(assignments, 1000, 2))
    named = chunks.withColumn("chunk_id", F.concat(F.lit("c"), F.concat_ws("|", "path", "topic_id", "part")))
    return points.chunk_pages(named, texts, ["page_text"]).withColumn(
        "body", points.pdf_body(F.col("title"), F.col("summary"), F.col("pages"))
    )


@add(f"WITH {_BODY_SQL} SELECT chunk_id, n_pages, hero_page, md5(body) AS body_md5 FROM kinds")
def chunk_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_chunks(spark, sf_dir).select(
        "chunk_id", F.size("page_refs").cast("long").alias("n_pages"), "hero_page", F.md5("body").alias("body_md5")
    )


@add(f"""WITH {_BODY_SQL},
m AS (SELECT *, unnest(CASE WHEN kind = 'text_topic' THEN ['text'] ELSE ['text', 'image'] END) AS modality FROM kinds)
SELECT sha256(chunk_id || '|' || modality) AS segment_id, chunk_id, modality, CASE kind WHEN 'pdf_topic' THEN 'pdf' WHEN 'text_topic' THEN 'text' ELSE 'image' END AS file_type,
  hero_page AS page, hero_page AS start_line, CAST(hero_page + n_pages AS INTEGER) AS end_line,
  CASE modality WHEN 'text' THEN md5(body) END AS embed_md5 FROM m""")
def point_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("topic_id") == "user", "pdf_topic").when(F.col("topic_id") == "system", "image").otherwise("text_topic")
    ranges = F.array(F.struct(F.col("hero_page").alias("start"), (F.col("hero_page") + F.size("page_refs")).alias("end")))
    chunks = conversation_chunks(spark, sf_dir).withColumn("kind", kind).withColumn("line_ranges", ranges)
    rows = points.materialise(points.modality_rows(chunks, F.col("body"), F.lit(True)))
    return rows.select(
        "segment_id", "chunk_id", "modality", "file_type", "page", "start_line", "end_line",
        F.md5("embed_text").alias("embed_md5"),
    )


@add("""
WITH t AS (SELECT vec_id // 4 AS page, vec_id, embedding[1] AS x, label FROM embeddings),
bad AS (SELECT page FROM t GROUP BY page HAVING arg_min(label, vec_id) = 0),
k AS (SELECT page // 15 AS chunk, row_number() OVER (PARTITION BY page // 15 ORDER BY vec_id) AS r, x FROM t WHERE page NOT IN (SELECT page FROM bad))
SELECT CAST(chunk AS BIGINT) AS chunk, count(*) AS n_tokens, round(sum(x * r), 4) AS position_sum FROM k GROUP BY chunk""")
def visual_multivectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of four vectors, chunks of fifteen pages; pages that begin with label 0 failed to embed."""
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("page"), "vec_id", "embedding", "label")
    gathered = F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))), lambda s: s["embedding"])
    pages = rows.groupBy("page").agg(gathered.alias("v"), F.min_by("label", "vec_id").alias("label")).select(
        F.lit("file").alias("path"), "page", F.when(F.col("label") != 0, F.col("v")).alias("vectors")
    )
    chunks = pages.groupBy("path", F.floor(F.col("page") / 15).alias("chunk_id")).agg(F.sort_array(F.collect_set("page")).alias("page_refs"))
    built = points.chunk_pages(chunks, pages, ["vectors"]).select(
        F.col("chunk_id").alias("chunk"), F.posexplode(points.visual_multivector(F.col("pages"))).alias("pos", "v")
    )
    first = F.get(F.col("v"), F.lit(0)).cast("double")
    return built.groupBy("chunk").agg(
        F.count("*").alias("n_tokens"), F.round(F.sum(first * (F.col("pos") + 1)), 4).alias("position_sum")
    )


# ---- model replies ------------------------------------------------------------------------------

# One reply per event, built from its own columns; by event type it is clean, fenced, cut short,
# padded with prose, or missing.
_K_SQL = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER)"


def rank_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    body = F.concat(
        F.lit('{"id": '), k % 9, F.lit(', "rank": '), k % 4, F.lit(', "score": '), k, F.lit('.5, "reason": " near '), F.col("event_type"),
        F.lit('"}, {"id": "'), (k + 1) % 9, F.lit('", "rank": "x", "reason": "second"}, {"id": null, "rank": 1}'),
    )
    event = F.col("event_type")
    reply = (
        F.when(event == "click", F.concat(F.lit("["), body, F.lit("]")))
        .when(event == "view", F.concat(F.lit('```json\n[7, null, "x", '), body, F.lit(', {"id": "1.5", "rank": 1}, {"id": [0]}]\n```')))
        .when(event == "error", F.concat(F.lit("["), body, F.lit(', {"id": 3, "reas')))
        .when(event == "purchase", F.concat(F.lit("[1] then, ranks: ["), body, F.lit("] done")))
        .otherwise(F.lit("no ranks today"))
    )
    return spread(table(spark, sf_dir, "events"), "event_id").select(
        F.col("event_id").cast("string").alias("query_id"), k.alias("k"), event.alias("event_type"), reply.alias("reply")
    )


@add(f"""
WITH e AS (SELECT CAST(event_id AS VARCHAR) AS query_id, event_type, {_K_SQL} AS k FROM events WHERE event_type IN ('click', 'view', 'error', 'purchase')),
r AS (SELECT query_id, 0 AS ord, k % 9 AS id, k % 4 AS rank, k + 0.5 AS score, 'near ' || event_type AS reason FROM e
  UNION ALL SELECT query_id, 1, (k + 1) % 9, 0, 0.0, 'second' FROM e)
SELECT query_id, ord, id, rank, CAST(score AS DOUBLE) AS score, reason FROM r WHERE id < 6""")
def rank_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six candidates per query: ids 6 to 8 of the replies are unknown and drop out."""
    replies = rank_replies(spark, sf_dir)
    candidates = F.sequence(F.lit(0), F.lit(5)).alias("candidates")
    return rerank.parse_ranks(replies.select("query_id", "reply", candidates))


@add(f"""
WITH e AS (SELECT event_id, event_type, user_id, {_K_SQL} AS k FROM events)
SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'whole' WHEN event_type IN ('error', 'purchase') THEN 'repaired' ELSE 'none' END AS outcome,
  CASE WHEN event_type IN ('click', 'view', 'purchase', 'error') THEN '{{"pages": [{{"page": ' || k || ', "topics": [{{"id": "t' || user_id || '", "title": "a, b"' ||
    CASE WHEN event_type IN ('click', 'view') THEN ', "summary": "s"' ELSE '' END || '}}]}}]}}' END AS json FROM e""")
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies cut inside the last value (``error``) or key (``purchase``) fall back to the value before it."""
    k = F.regexp_extract("props", "([0-9]+)", 1)
    event = F.col("event_type")
    stem = F.concat(F.lit('{"pages": [{"page": '), k, F.lit(', "topics": [{"id": "t'), "user_id", F.lit('", "title": "a, b"'))
    whole = F.concat(stem, F.lit(', "summary": "s"}]}]}'))
    reply = (
        F.when(event == "click", F.concat(F.lit("Sure: "), whole, F.lit(" bye")))
        .when(event == "view", F.concat(F.lit("```json\n"), whole, F.lit("\n```  ")))
        .when(event == "error", F.concat(stem, F.lit(', "summary": "s, {t}')))
        .when(event == "purchase", F.concat(stem, F.lit(', "summ}')))
        .otherwise(F.lit("nothing"))
    )
    blob = jsonx.json_block(reply)
    fixed = jsonx.repair_json(blob)
    return spread(table(spark, sf_dir, "events"), "event_id").select(
        "event_id",
        F.when(blob.isNull(), "none").when(fixed == blob, "whole").otherwise("repaired").alias("outcome"),
        fixed.alias("json"),
    )


@add(f"""
WITH e AS (SELECT event_id, user_id, event_type, {_K_SQL} AS k FROM events WHERE event_type <> 'signup'),
t AS (SELECT event_id, 1 AS j, k AS page, 'a' || user_id AS topic_id, false AS c, 'First ' || event_type AS title FROM e
  UNION ALL SELECT event_id, 2, k, 'b', true, 'carried on' FROM e
  UNION ALL SELECT event_id, 3, k + 1, 'c', false, 'Second' FROM e
  UNION ALL SELECT event_id, 4, k + 1, 'd', false, 'First ' || event_type FROM e)
SELECT CAST(event_id AS VARCHAR) AS path, page, topic_id, c AS is_continuation, title FROM t""")
def topic_reply_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-page windows with at most two new titles: the third new one and stray pages drop out."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")

    def topic(topic_id: Column, carried: str, title: Column) -> Column:
        return F.concat(F.lit('{"id": "'), topic_id, F.lit(f'", "is_continuation": {carried}, "title": "'), title, F.lit('"}'))

    first = F.concat(F.lit("First "), "event_type")
    reply = F.concat(
        F.lit('{"pages": [{"page": '), k, F.lit(', "topics": ['),
        topic(F.concat(F.lit("a"), "user_id"), "false", first), F.lit(", "), topic(F.lit("b"), "true", F.lit("carried on")),
        F.lit(', {"id": "", "title": "no id"}, {"id": 5, "title": "a number"}, 7, "junk"]}, 9, {"page": "1", "topics": [{"id": "z"}]}, {"page": '), k + 1, F.lit(', "topics": ['),
        topic(F.lit("c"), "false", F.lit(" Second ")), F.lit(", "), topic(F.lit("d"), "false", first), F.lit(", "), topic(F.lit("e"), "false", F.lit("Third")),
        F.lit(']}, {"page": '), k + 7, F.lit(', "topics": ['), topic(F.lit("f"), "true", F.lit("stray")), F.lit("]}]}"),
    )
    replies = spread(table(spark, sf_dir, "events"), "event_id").select(
        F.col("event_id").cast("string").alias("path"), F.lit(0).alias("window_no"), F.array(k, k + 1).alias("pages"),
        F.when(F.col("event_type") != "signup", reply).alias("reply"),
    )
    return jsonx.parse_page_topics(replies, max_topics=2).select("path", "page", "topic_id", "is_continuation", "title")


@add(f"""
WITH e AS (SELECT CAST(event_id AS VARCHAR) AS path, {_K_SQL} AS k FROM events)
SELECT path, 0 AS ord, 'Intro' AS title, '101-' || (least(k + 1, 40) + 100) || CASE WHEN k >= 1 THEN ' ' || (least(k, 40) + 100) || '-140' ELSE '' END AS spans FROM e""")
def text_topic_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges are clamped to a window of 40 lines and shifted by 100; bad ranges and topics drop out."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    reply = F.concat(
        F.lit('[{"title": " Intro ", "ranges": [[1, '), k + 1, F.lit("], ["), k, F.lit(', 500], [9, 3], [1], ["x", 2], 7, {"a": 1}]}, 5, null, '),
        F.lit('{"title": "", "ranges": [[1, 2]]}, {"title": "None", "ranges": [[5, 4]]}]'),
    )
    replies = spread(table(spark, sf_dir, "events"), "event_id").select(
        F.col("event_id").cast("string").alias("path"), F.lit(0).alias("window_no"), F.lit(40).alias("n_lines"),
        F.lit(100).alias("line_offset"), reply.alias("reply"),
    )
    spans = F.array_join(F.transform("ranges", lambda r: F.concat_ws("-", r["start"], r["end"])), " ")
    return jsonx.parse_text_topics(replies).select("path", "ord", "title", spans.alias("spans"))
