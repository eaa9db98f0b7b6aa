"""Presentation and evaluation. Conversations act as searches whose turns are the results; for grading,
users act as questions and their events, ranked three ways, as results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillfin.operators import listing
from quillfin.plans import evaluate, present
from quillfin.showcase import Showcase, table

shown = Showcase()
add = shown.add

# ---- presentation -------------------------------------------------------------------------------

_HITS_SQL = """
raw AS (SELECT CAST(conv_id AS VARCHAR) AS query_id, CAST(turn AS INTEGER) + 1 AS rank, CAST(turn AS INTEGER) AS t, role, text FROM conversations),
hits AS (SELECT query_id, rank, round(1.0 / (t + 2), 3)::DOUBLE AS score, '/talk/' || query_id || '/' || role || t || '.md' AS path,
  CASE role WHEN 'user' THEN 'pdf' ELSE 'text' END AS file_type, 'text' AS modality,
  CASE role WHEN 'user' THEN t + 2 END AS page,
  CASE role WHEN 'assistant' THEN 1 ELSE t END AS start_line, CASE role WHEN 'assistant' THEN t + 3 ELSE t + 5 END AS end_line,
  CASE role WHEN 'system' THEN 'About ' || text ELSE text END AS excerpt, 'c' || query_id || '.' || t AS chunk_id,
  CASE role WHEN 'system' THEN '' ELSE upper(role) END AS title, CASE role WHEN 'assistant' THEN '' ELSE 'About ' || text END AS summary,
  CASE role WHEN 'user' THEN [t + 1, t + 2, t + 4] END AS page_refs, CASE role WHEN 'assistant' THEN [[1, t + 3], [t + 9, t + 12]] END AS line_ranges,
  sha256(query_id) AS sha, CASE WHEN t % 2 = 1 THEN 'moved up' END AS rerank_reason FROM raw),
cached AS (SELECT sha256(CAST(conv_id AS VARCHAR)) AS sha, CAST(turn AS INTEGER) + 1 AS page, text AS image FROM conversations),
refs AS (SELECT query_id, rank, h.sha, unnest(page_refs) AS page, generate_subscripts(page_refs, 1) AS pos FROM hits h),
ctx AS (SELECT r.query_id, r.rank, r.pos, r.page, CASE WHEN c.sha IS NOT NULL THEN '/cache/' || substr(r.sha, 1, 2) || '/' || r.sha || '/' || r.page || '.webp' END AS img_path,
  to_base64(encode(c.image)) AS img_b64, strlen(c.image) AS img_size FROM refs r LEFT JOIN cached c USING (sha, page)),
dir AS (SELECT '/talk/' || query_id AS directory, path, regexp_extract(path, '[^/]*$', 0) AS name, row_number() OVER (PARTITION BY query_id ORDER BY lower(path), path) AS r,
  count(*) OVER (PARTITION BY query_id) AS n FROM hits),
loc AS (SELECT directory, list(CASE WHEN n > 4 AND r = 2 THEN [name, '...'] ELSE [name] END ORDER BY r) AS names, n > 4 AS cut, n FROM dir
  WHERE n <= 4 OR r <= 2 OR r > n - 2 GROUP BY directory, n)
"""


def stored_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    t = F.col("turn").cast("int")
    role = F.col("role")
    query = F.col("conv_id").cast("string")
    about = F.concat(F.lit("About "), "text")

    def span(a: Column, b: Column) -> Column:
        return F.struct(a.alias("start"), b.alias("end"))

    return turns.select(
        query.alias("query_id"),
        (t + 1).alias("rank"),
        F.round(1.0 / (t + 2), 3).alias("score"),
        F.concat(F.lit("/talk/"), query, F.lit("/"), role, t, F.lit(".md")).alias("path"),
        F.when(role == "user", "pdf").otherwise("text").alias("file_type"),
        F.lit("text").alias("modality"),
        F.lit(None).cast("int").alias("page"),
        t.alias("start_line"),
        (t + 5).alias("end_line"),
        F.when(role == "system", "").otherwise(F.col("text")).alias("excerpt"),
        F.concat(F.lit("c"), query, F.lit("."), t).alias("chunk_id"),
        F.when(role == "system", "").otherwise(F.upper(role)).alias("title"),
        F.when(role == "assistant", "").otherwise(about).alias("summary"),
        F.when(role == "user", F.array(t + 1, t + 2, t + 4)).otherwise(F.array().cast("array<int>")).alias("page_refs"),
        F.when(role == "assistant", F.array(span(F.lit(1), t + 3), span(t + 9, t + 12)))
        .otherwise(F.array().cast("array<struct<start:int,end:int>>")).alias("line_ranges"),
        F.when(role == "user", t + 2).otherwise(F.lit(0)).alias("hero_page"),
        F.sha2(query, 256).alias("file_sha256"),
        F.when(t % 2 == 1, "moved up").alias("rerank_reason"),
    )


def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.sha2(F.col("conv_id").cast("string"), 256).alias("sha"), (F.col("turn") + 1).alias("page"), F.encode("text", "UTF-8").alias("image")
    )


def results(spark: SparkSession, sf_dir: str, mode: str = "path") -> DataFrame:
    hits = stored_hits(spark, sf_dir)
    listings = listing.directory_listings(
        listing.entries_of(hits.select("path")).where(~F.endswith("name", F.lit("/"))), max_entries=4
    )
    shown_pages = present.attach_pages(present.project(hits), page_images(spark, sf_dir), mode, "/cache")
    return present.attach_location(shown_pages, listings)


def _flat(df: DataFrame) -> DataFrame:
    pages = F.transform("context_pages", lambda p: F.concat_ws("=", p["page"], F.coalesce(p["page_image_path"], F.md5(p["page_image_b64"]), F.lit(""))))
    return df.select(
        "query_id", "rank", "page", "start_line", "end_line",
        F.md5("excerpt").alias("excerpt_md5"),
        F.md5("summary").alias("summary_md5"),
        F.array_join(pages, " ").alias("images"),
        F.concat_ws(" ", F.array_join("location.directory_listing", "|"), "location.listing_truncated", "location.listing_total").alias("listing"),
    )


_LISTING = "array_to_string(flatten(l.names), '|') || ' ' || l.cut || ' ' || l.n"


@add(f"""WITH {_HITS_SQL},
cx AS (SELECT query_id, rank, string_agg(page || '=' || coalesce(img_path, ''), ' ' ORDER BY pos) AS images FROM ctx GROUP BY ALL)
SELECT h.query_id, h.rank, h.page, h.start_line, h.end_line, md5(h.excerpt) AS excerpt_md5, md5(h.summary) AS summary_md5, coalesce(images, '') AS images,
  {_LISTING} AS listing FROM hits h LEFT JOIN cx USING (query_id, rank) JOIN loc l ON l.directory = '/talk/' || h.query_id""")
def result_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(results(spark, sf_dir))


@add(f"""WITH {_HITS_SQL},
hero AS (SELECT query_id, rank, min(pos) AS pos FROM ctx JOIN hits h USING (query_id, rank) WHERE img_b64 IS NOT NULL AND ctx.page = h.page GROUP BY ALL),
cx AS (SELECT c.query_id, c.rank, string_agg(c.page || '=' || CASE WHEN c.pos = o.pos THEN md5(c.img_b64) ELSE '' END, ' ' ORDER BY c.pos) AS images
  FROM ctx c LEFT JOIN hero o USING (query_id, rank) GROUP BY ALL)
SELECT h.query_id, h.rank, h.page, h.start_line, h.end_line,
  md5(CASE WHEN length(h.excerpt) > 240 THEN substr(h.excerpt, 1, 240) || '...' ELSE h.excerpt END) AS excerpt_md5,
  md5(CASE WHEN length(h.summary) > 240 THEN substr(h.summary, 1, 240) || '...' ELSE h.summary END) AS summary_md5, coalesce(images, '') AS images,
  {_LISTING} AS listing FROM hits h LEFT JOIN cx USING (query_id, rank) JOIN loc l ON l.directory = '/talk/' || h.query_id""")
def compact_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(present.compact(results(spark, sf_dir, "base64")))


@add(f"""WITH RECURSIVE {_HITS_SQL},
hero AS (SELECT h.query_id, h.rank, coalesce(min(c.pos) FILTER (c.page = h.page OR c.page = h.page_refs[1]), 1) AS pos FROM hits h JOIN ctx c USING (query_id, rank) GROUP BY ALL),
hp AS (SELECT o.query_id, o.rank, c.page, c.img_path, c.img_size, c.img_b64, row_number() OVER (PARTITION BY o.query_id ORDER BY o.rank) AS n FROM hero o JOIN ctx c USING (query_id, rank, pos)),
fold AS (SELECT query_id, n, CASE WHEN img_size <= 1000 THEN img_size ELSE 0 END AS used, coalesce(img_size <= 1000, false) AS kept FROM hp WHERE n = 1
  UNION ALL SELECT h.query_id, h.n, f.used + CASE WHEN f.used + h.img_size <= 1000 THEN h.img_size ELSE 0 END, coalesce(f.used + h.img_size <= 1000, false)
  FROM fold f JOIN hp h ON h.query_id = f.query_id AND h.n = f.n + 1)
SELECT h.query_id, h.rank, md5(substr(h.excerpt, 1, 400)) AS excerpt_md5, hp.page AS hero_page, hp.img_path AS hero_page_image_path,
  md5(CASE WHEN fold.kept THEN hp.img_b64 END) AS image_md5, '/talk/' || h.query_id AS directory
FROM hits h LEFT JOIN hp USING (query_id, rank) LEFT JOIN fold ON fold.query_id = hp.query_id AND fold.n = hp.n""")
def trimmed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = page_images(spark, sf_dir).select(
        F.concat(F.lit("/cache/"), present.page_path(F.col("sha"), F.col("page"))).alias("page_image_path"), "image"
    )
    slim = present.trim(results(spark, sf_dir), images, 1000)
    return slim.select(
        "query_id", "rank", F.md5("excerpt").alias("excerpt_md5"), "hero_page", "hero_page_image_path",
        F.md5("hero_page_image_b64").alias("image_md5"), F.col("location.directory").alias("directory"),
    )


def answered(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """A response per conversation; odd conversations report a skipped file and an error."""
    convs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("n"))
    odd = F.col("conv_id") % 2 == 1
    requests = convs.select(
        F.col("conv_id").cast("string").alias("query_id"),
        F.concat(F.lit("talk "), "conv_id").alias("query"),
        F.when(odd, "partial").otherwise("complete").alias("status"),
        F.col("n").alias("files_added"),
        F.lit(0).alias("files_updated"),
        F.lit(1).alias("files_skipped_unchanged"),
        F.when(odd, F.array(F.struct(F.concat(F.lit("/x/"), "conv_id").alias("path"), F.lit("unsupported file type").alias("reason"))))
        .otherwise(F.array().cast("array<struct<path:string,reason:string>>")).alias("skipped"),
        F.when(odd, F.array(F.lit("Retrieval error: none"))).otherwise(F.array().cast("array<string>")).alias("errors"),
        (F.col("conv_id") + 0.5).alias("total_ms"),
    )
    return present.responses(requests, rows)


@add(f"""WITH {_HITS_SQL},
req AS (SELECT CAST(conv_id AS VARCHAR) AS query_id, conv_id, max(turn) AS n, count(*) AS total FROM conversations GROUP BY conv_id),
blk AS (SELECT query_id, string_agg('### ' || rank || '. ' || path || ' (score: ' || score || ')' || chr(10) || '**Type**: ' || file_type || ' | **Modality**: ' || modality ||
  CASE WHEN page IS NOT NULL THEN ' | **Page**: ' || page ELSE ' | **Lines**: ' || start_line || '-' || end_line END || chr(10) || '> ' ||
  CASE WHEN length(excerpt) > 200 THEN substr(excerpt, 1, 200) || '...' ELSE excerpt END || chr(10) || chr(10), '' ORDER BY rank) AS body, count(*) AS k FROM hits GROUP BY query_id)
SELECT query_id, md5('# Search Results: "talk ' || conv_id || '"' || chr(10) || chr(10) || '**Status**: ' || CASE WHEN conv_id % 2 = 1 THEN 'partial' ELSE 'complete' END ||
  ' | **Total**: ' || k || ' results | **Time**: ' || conv_id || '.5ms' || chr(10) || chr(10) || '## Indexing' || chr(10) || '- Added: ' || n || ' files | Updated: 0 | Skipped (unchanged): 1' || chr(10) || chr(10) ||
  '## Results' || chr(10) || chr(10) || CASE WHEN conv_id % 2 = 1 THEN body || '## Skipped Files' || chr(10) || chr(10) || '- /x/' || conv_id || ': unsupported file type' || chr(10) || chr(10) ||
  '## Errors' || chr(10) || chr(10) || '- Retrieval error: none' || chr(10) ELSE substr(body, 1, length(body) - 1) END) AS response_md5
FROM req JOIN blk USING (query_id)""")
def markdown_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown_as = present.as_markdown(answered(spark, sf_dir, results(spark, sf_dir)))
    return shown_as.select("query_id", F.md5("response").alias("response_md5"))


@add(f"""WITH {_HITS_SQL},
req AS (SELECT CAST(conv_id AS VARCHAR) AS query_id, conv_id, max(turn) AS n FROM conversations GROUP BY conv_id),
imgs AS (SELECT query_id, rank, string_agg(CASE WHEN img_path IS NOT NULL THEN chr(10) || '![page ' || page || '](file://' || img_path || ')' ELSE '' END, '' ORDER BY pos) AS imgs FROM ctx GROUP BY ALL),
x AS (SELECT h.*, regexp_replace(excerpt, '^\\s+|\\s+$', '', 'g') AS e, imgs, l.names, l.cut, l.n AS listed FROM hits h LEFT JOIN imgs USING (query_id, rank) JOIN loc l ON l.directory = '/talk/' || h.query_id),
blk AS (SELECT query_id, count(*) AS k, string_agg('## ' || rank || '. ' || CASE WHEN title = '' THEN regexp_extract(path, '[^/]*$', 0) ELSE title END || '  (score ' || printf('%.3f', score) || ')' || chr(10) ||
  '**File**: `' || path || '`' ||
  CASE WHEN page_refs IS NOT NULL THEN ' · **Pages**: ' || page_refs[1] || '–' || page_refs[2] || ', ' || page_refs[3] ELSE '' END ||
  CASE WHEN line_ranges IS NOT NULL THEN ' · **Lines**: ' || line_ranges[1][1] || '-' || line_ranges[1][2] || ', ' || line_ranges[2][1] || '-' || line_ranges[2][2] ELSE '' END ||
  ' · **Modality**: ' || modality || chr(10) ||
  CASE WHEN summary <> '' THEN '_' || summary || '_' || chr(10) ELSE '' END ||
  CASE WHEN rerank_reason IS NOT NULL THEN '> **Rerank reason:** ' || rerank_reason || chr(10) ELSE '' END ||
  CASE WHEN excerpt <> '' THEN chr(10) || '> ' || replace(CASE WHEN length(e) > 600 THEN substr(e, 1, 600) || '...' ELSE e END, chr(10), chr(10) || '> ') || chr(10) ELSE '' END ||
  CASE WHEN page_refs IS NOT NULL THEN imgs || chr(10) ELSE '' END ||
  chr(10) || '**Location**: `/talk/' || query_id || '`' || chr(10) || 'Directory contents (' || listed || CASE WHEN cut THEN ', truncated' ELSE '' END || '):' || chr(10) ||
  '  - ' || array_to_string(flatten(names), chr(10) || '  - ') || chr(10) || chr(10), '' ORDER BY rank) AS body FROM x GROUP BY query_id)
SELECT query_id, md5('# Search: "talk ' || conv_id || '"' || chr(10) || chr(10) || '**Status**: ' || CASE WHEN conv_id % 2 = 1 THEN 'partial' ELSE 'complete' END ||
  ' · **Results**: ' || k || ' · **Time**: ' || (conv_id + 1) || ' ms' || chr(10) || chr(10) || 'Indexed: +' || n || ' added, ~0 updated, =1 unchanged' || chr(10) || chr(10) ||
  CASE WHEN conv_id % 2 = 1 THEN body || '## Skipped' || chr(10) || '- `/x/' || conv_id || '`: unsupported file type' || chr(10) || chr(10) || '## Errors' || chr(10) || '- Retrieval error: none' || chr(10)
  ELSE substr(body, 1, length(body) - 1) END) AS response_md5 FROM req JOIN blk USING (query_id)""")
def rich_markdown_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown_as = present.as_rich_markdown(answered(spark, sf_dir, results(spark, sf_dir)))
    return shown_as.select("query_id", F.md5("response").alias("response_md5"))


@add(f"""WITH {_HITS_SQL},
req AS (SELECT CAST(conv_id AS VARCHAR) AS query_id, conv_id, max(turn) AS n FROM conversations GROUP BY conv_id),
rs AS (SELECT query_id, list({{'rank': rank, 'path': path, 'page': page, 'title': title}} ORDER BY rank) AS results FROM hits GROUP BY query_id)
SELECT query_id, to_json({{'query': 'talk ' || conv_id, 'status': CASE WHEN conv_id % 2 = 1 THEN 'partial' ELSE 'complete' END, 'files_added': n, 'files_updated': 0, 'files_skipped_unchanged': 1,
  'skipped': CASE WHEN conv_id % 2 = 1 THEN [{{'path': '/x/' || conv_id, 'reason': 'unsupported file type'}}] ELSE [] END,
  'errors': CASE WHEN conv_id % 2 = 1 THEN ['Retrieval error: none'] ELSE [] END, 'total_ms': conv_id + 0.5, 'results': results}})::VARCHAR AS response
FROM req JOIN rs USING (query_id)""")
def json_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = results(spark, sf_dir).select("query_id", "rank", "path", "title", "page")
    return present.as_json(answered(spark, sf_dir, slim), pretty=False)


@add("SELECT event_id, user_id, event_type, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present.recent(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts"), "ts", "event_id")


# ---- evaluation ---------------------------------------------------------------------------------

_RANKINGS = {"by_value": "value DESC, event_id", "newest": "event_id DESC", "by_k": "k DESC, event_id"}


def _grade_sql(order: str) -> str:
    return f"""
SELECT q.query_id, q.difficulty, coalesce(bool_or(hit AND rank <= 1), false) AS top1, coalesce(bool_or(hit AND rank <= 5), false) AS top5,
  coalesce(bool_or(hit AND rank <= 10), false) AS top10, coalesce(1.0 / min(rank) FILTER (hit), 0)::DOUBLE AS mrr,
  coalesce(contains(c, 'error {{"k": 9') OR contains(c, 'signup {{"k": 1'), false) AS semantic5, CAST(coalesce(any_value(np), 0) AS INTEGER) AS distinct_pages_top10
FROM q LEFT JOIN (SELECT *, (k BETWEEN lo AND hi) OR (hod BETWEEN lo AND hi) AS hit FROM
   (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS rank, (user_id * 7) % 90 AS lo, (user_id * 7) % 90 + 1 AS hi FROM ev)) r ON r.user_id = q.user_id
LEFT JOIN (SELECT user_id, string_agg(lower('Event ' || event_type), ' ' ORDER BY rank) || string_agg(' ' || event_type || ' ' || props, '' ORDER BY rank) AS c
   FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS rank FROM ev) WHERE rank <= 5 GROUP BY user_id) x ON x.user_id = q.user_id
LEFT JOIN (SELECT user_id, count(DISTINCT p) AS np FROM (SELECT user_id, unnest([k, hod]) AS p, rank FROM
   (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS rank FROM ev) WHERE rank <= 10) GROUP BY user_id) y ON y.user_id = q.user_id
GROUP BY q.query_id, q.difficulty, c"""


_EVENTS_SQL = """
ev AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, CAST(date_part('hour', ts) AS INTEGER) AS hod FROM events),
q AS (SELECT DISTINCT user_id, CAST(user_id AS VARCHAR) AS query_id, ['E', 'M', 'H'][user_id % 3 + 1] AS difficulty FROM events)
"""


def event_results(spark: SparkSession, sf_dir: str, ranking: str) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    rows = table(spark, sf_dir, "events").withColumn("k", k)
    order = {
        "by_value": [F.desc("value"), F.col("event_id")],
        "newest": [F.desc("event_id")],
        "by_k": [F.desc("k"), F.col("event_id")],
    }[ranking]
    # Grades look at all results of a question, however many it has.
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(*order))
    return rows.select(
        F.col("user_id").cast("string").alias("query_id"),
        rank.alias("rank"),
        F.concat_ws("/", F.lit("/log"), "event_type", "k").alias("path"),
        F.lit(None).cast("int").alias("page"),
        F.array("k", F.hour("ts")).alias("page_refs"),
        F.concat(F.lit("Event "), "event_type").alias("excerpt"),
        F.col("event_type").alias("title"),
        F.col("props").alias("summary"),
    )


def event_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    lo = ((F.col("user_id") * 7) % 90).cast("int")
    return users.select(
        F.col("user_id").cast("string").alias("query_id"),
        lo.alias("lo"),
        (lo + 1).alias("hi"),
        F.array(F.lit('ERROR {"k": 9'), F.lit('Signup {"k": 1')).alias("must_contain_any"),
        F.get(F.array(F.lit("E"), F.lit("M"), F.lit("H")), (F.col("user_id") % 3).cast("int")).alias("difficulty"),
    )


def _grades(spark: SparkSession, sf_dir: str, ranking: str) -> DataFrame:
    return evaluate.grade(event_results(spark, sf_dir, ranking), event_questions(spark, sf_dir))


@add(f"WITH {_EVENTS_SQL} {_grade_sql(_RANKINGS['by_value'])}")
def grade_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grades(spark, sf_dir, "by_value")


def _summary_sql(group: str) -> str:
    keys = ("p_at_1", "top1"), ("p_at_5", "top5"), ("p_at_10", "top10"), ("mrr", "mrr"), ("semantic_at_5", "semantic5"), ("avg_distinct_pages_top10", "distinct_pages_top10")
    means = ", ".join(f"round(avg(CAST({c} AS DOUBLE)), 4) AS {n}" for n, c in keys)
    return f"count(*) AS n, {means} FROM {{g}} {group}"


@add(f"""WITH {_EVENTS_SQL}, g AS ({_grade_sql(_RANKINGS['by_value'])})
SELECT difficulty, {_summary_sql('GROUP BY GROUPING SETS ((), (difficulty))').format(g='g')}""")
def grade_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summarise(_grades(spark, sf_dir, "by_value"))


def _metric_sql(ranking: str) -> str:
    names = "p_at_1, p_at_5, p_at_10, mrr, semantic_at_5, avg_distinct_pages_top10"
    return f"""SELECT metric, value FROM (SELECT {_summary_sql('').format(g='(' + _grade_sql(_RANKINGS[ranking]) + ')')}) UNPIVOT (value FOR metric IN ({names}))"""


def _report(spark: SparkSession, sf_dir: str, ranking: str) -> DataFrame:
    summary = evaluate.summarise(_grades(spark, sf_dir, ranking)).where("difficulty IS NULL")
    return evaluate.metric_rows(summary)


@add(f"""WITH {_EVENTS_SQL}, a AS ({_metric_sql('by_value')}), b AS ({_metric_sql('newest')}),
m AS (SELECT unnest(['p_at_1', 'p_at_5', 'p_at_10', 'mrr', 'semantic_at_5', 'avg_distinct_pages_top10', 'avg_query_wall_s', 'index_wall_s']) AS metric),
d AS (SELECT metric, coalesce(a.value, 0) AS a, coalesce(b.value, 0) AS b FROM m LEFT JOIN a USING (metric) LEFT JOIN b USING (metric))
SELECT metric, a, b, b - a AS delta, CASE WHEN metric LIKE '%wall_s' THEN b - a <= 0 ELSE b - a >= 0 END AS better, metric = 'semantic_at_5' AND b - a < -1e-6 AS regression FROM d""")
def report_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.report_diff(_report(spark, sf_dir, "by_value"), _report(spark, sf_dir, "newest"))


@add(f"""WITH {_EVENTS_SQL}, a AS ({_metric_sql('by_value')}), b AS ({_metric_sql('newest')}), c AS ({_metric_sql('by_k')})
SELECT metric, a.value AS by_value, b.value AS newest, c.value AS by_k FROM a JOIN b USING (metric) JOIN c USING (metric)""")
def report_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.report_matrix({name: _report(spark, sf_dir, name) for name in _RANKINGS})


_CHECK_SQL = f"""WITH {_EVENTS_SQL},
r AS (SELECT user_id, count(*) AS got, bool_or(contains(path, 'error/9') OR contains(path, 'click/8')) AS matched FROM
  (SELECT user_id, '/log/' || event_type || '/' || k AS path, row_number() OVER (PARTITION BY user_id ORDER BY {_RANKINGS['by_k']}) AS rank FROM ev) GROUP BY user_id),
s AS (SELECT user_id, count(*) AS ns FROM ev WHERE value < 0.1 GROUP BY user_id),
c AS (SELECT q.query_id, CAST(CAST(got >= 60 AS INTEGER) + CASE WHEN difficulty <> 'H' AND matched THEN 1 ELSE 0 END + CASE WHEN difficulty = 'E' AND coalesce(ns, 0) > 0 THEN 1 ELSE 0 END AS INTEGER) AS passed,
  CAST(1 + CASE WHEN difficulty <> 'H' THEN 1 ELSE 0 END + CASE WHEN difficulty = 'E' THEN 1 ELSE 0 END AS INTEGER) AS total
FROM q JOIN r USING (user_id) LEFT JOIN s USING (user_id))"""


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = event_questions(spark, sf_dir).select(
        "query_id",
        F.lit(60).alias("min_results"),
        F.when(F.col("difficulty") != "H", F.array(F.lit("error/9"), F.lit("click/8"))).alias("expected_paths_contain"),
        (F.col("difficulty") == "E").alias("expect_skipped"),
    )
    skipped = table(spark, sf_dir, "events").where("value < 0.1").select(F.col("user_id").cast("string").alias("query_id"))
    return evaluate.run_checks(event_results(spark, sf_dir, "by_k"), skipped, questions)


@add(f"{_CHECK_SQL} SELECT query_id, passed, total FROM c")
def validation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checks(spark, sf_dir)


@add(f"{_CHECK_SQL} SELECT CAST(sum(passed) AS BIGINT) AS passed, CAST(sum(total) AS BIGINT) AS total FROM c")
def validation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.totals(_checks(spark, sf_dir))
