"""Files: paths from ``pages.url``, contents from ``documents.text``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfin.functions import text as tx
from quillfin.models.rerank import rank_prompt
from quillfin.models.topics import text_prompt
from quillfin.operators import cache, chunking, listing, state, topics
from quillfin.operators.topics import page_label
from quillfin.showcase import Showcase, table
from quillfin.sources.content import decode_text, file_type

shown = Showcase()
add = shown.add


@add("""
SELECT doc_id, sha256(text) AS content_hash_sha256,
       CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INTEGER) AS n_lines,
       CAST(length(text) AS INTEGER) AS n_characters,
       CAST(greatest(1, length(text) // 4) AS INTEGER) AS est_tokens
FROM documents
""")
def doc_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return state.fingerprints(docs, "text").select(
        "doc_id",
        "content_hash_sha256",
        (tx.newlines(F.col("text")) + 1).alias("n_lines"),
        F.length("text").alias("n_characters"),
        tx.token_estimate(F.col("text")).alias("est_tokens"),
    )


_STATE_SQL = """
cur AS (SELECT '/corpus/' || source || '/' || doc_id || '.txt' AS path, doc_id, sha256(text) AS h FROM documents),
old AS (SELECT c.path, CASE WHEN l.quality = 1 THEN c.h ELSE sha256(c.h) END AS h,
               CASE WHEN l.toxic = 0 THEN [sha256(c.path || '|text')] ELSE []::VARCHAR[] END AS point_ids
        FROM cur c JOIN labels l USING (doc_id)),
planned AS (SELECT cur.path, CASE WHEN old.h IS NULL THEN 'new' WHEN old.h <> cur.h THEN 'changed' ELSE 'unchanged' END AS action,
                   CAST(coalesce(len(old.point_ids), 0) AS INTEGER) AS n_points
            FROM cur LEFT JOIN old USING (path))
"""


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents are the files indexed before; low quality means edited since, toxic means
    the earlier run stored no points."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    path = F.concat_ws("/", F.lit("/corpus"), "source", F.concat("doc_id", F.lit(".txt")))
    current = state.fingerprints(docs, "text").select(path.alias("path"), "doc_id", "content_hash_sha256")
    seen = current.join(table(spark, sf_dir, "labels"), "doc_id").select(
        "path",
        F.when(F.col("quality") == 1, F.col("content_hash_sha256"))
        .otherwise(F.sha2("content_hash_sha256", 256)).alias("content_hash_sha256"),
        F.when(F.col("toxic") == 0, F.array(F.sha2(F.concat("path", F.lit("|text")), 256)))
        .otherwise(F.array().cast("array<string>")).alias("point_ids"),
    )
    return state.staleness(current, seen)


@add(f"WITH {_STATE_SQL} SELECT path, action, n_points FROM planned")
def stale_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(spark, sf_dir).select(
        "path", "action", F.coalesce(F.size("point_ids"), F.lit(0)).alias("n_points")
    )


@add(f"""WITH {_STATE_SQL}
SELECT count(*) FILTER (action <> 'unchanged' AND n_points = 0) AS files_added,
       count(*) FILTER (action <> 'unchanged' AND n_points > 0) AS files_updated,
       count(*) FILTER (action = 'unchanged') AS files_skipped_unchanged FROM planned""")
def ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.ingest_stats(_planned(spark, sf_dir))


@add(f"""WITH {_STATE_SQL}
SELECT o.point_id AS segment_id, CAST(2 AS BIGINT) AS version
FROM planned p JOIN (SELECT path, unnest(point_ids) AS point_id FROM old) o USING (path) WHERE p.action = 'changed'""")
def superseded_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.superseded_points(_planned(spark, sf_dir), 2)


_PAGE_PATH_SQL = r"""
files AS (SELECT page_id, html,
  '/web/' || regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '^(m|blog)\.', '.\1/') AS path
  FROM pages)
"""


def _page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files; mobile and blog hosts become hidden directories."""
    bare = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select(
        "page_id", "html", F.concat(F.lit("/web/"), F.regexp_replace(bare, r"^(m|blog)\.", r".$1/")).alias("path")
    )


@add(rf"""WITH {_PAGE_PATH_SQL}
SELECT page_id, path, CASE WHEN regexp_matches(substr(path, 6), '(^|/)\.') THEN 'hidden'
   WHEN regexp_extract(path, '[^/]*$', 0) = '' THEN 'no name' ELSE 'kept' END AS fate FROM files""")
def visible_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    relative = F.substring("path", len("/web/") + 1, 1 << 30)
    return _page_files(spark, sf_dir).select(
        "page_id",
        "path",
        F.when(~listing.visible(relative), "hidden")
        .when(tx.basename(F.col("path")) == "", "no name")
        .otherwise("kept").alias("fate"),
    )


# Paths without a trailing slash; requests are all host directories that hold a page of the newest
# and of the oldest kind of address, so every page takes part.
@add(rf"""WITH {_PAGE_PATH_SQL},
clean AS (SELECT DISTINCT rtrim(path, '/') AS path FROM files),
req AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS request FROM clean)
SELECT r.request, c.path FROM req r JOIN clean c ON c.path = r.request OR starts_with(c.path, r.request || '/')""")
def expand_request_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = _page_files(spark, sf_dir).select(F.regexp_replace("path", "/+$", "").alias("path")).distinct()
    requests = clean.select(tx.dirname(F.col("path")).alias("request")).distinct()
    return listing.expand_requests(requests, clean)


@add(rf"""WITH {_PAGE_PATH_SQL},
clean AS (SELECT DISTINCT rtrim(path, '/') AS path FROM files),
chain AS (SELECT path, unnest(range(2, len(string_split(path, '/')) + 1)) AS n FROM clean),
node AS (SELECT path, array_to_string(list_slice(string_split(path, '/'), 1, n), '/') AS node FROM chain),
entry AS (SELECT DISTINCT CASE WHEN regexp_replace(node, '/[^/]*$', '') = '' THEN '/' ELSE regexp_replace(node, '/[^/]*$', '') END AS directory,
   regexp_extract(node, '[^/]*$', 0) || CASE WHEN node = path THEN '' ELSE '/' END AS name FROM node),
num AS (SELECT directory, name, row_number() OVER (PARTITION BY directory ORDER BY lower(name), name) AS r,
   count(*) OVER (PARTITION BY directory) AS total FROM entry)
SELECT directory, string_agg(CASE WHEN total > 8 AND r = 4 THEN name || '|...' ELSE name END, '|' ORDER BY r) AS listing,
   total > 8 AS truncated, total
FROM num WHERE total <= 8 OR r <= 4 OR r > total - 4 GROUP BY directory, total""")
def directory_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = _page_files(spark, sf_dir).select(F.regexp_replace("path", "/+$", "").alias("path")).distinct()
    found = listing.directory_listings(listing.entries_of(clean), max_entries=8)
    return found.select("directory", F.array_join("listing", "|").alias("listing"), "truncated", "total")


@add(r"""
SELECT page_id, url, regexp_matches(x, '^(es|fr)$') OR x LIKE '9%' OR regexp_matches(x, '^.[0-5]5$') AS ignored
FROM (SELECT page_id, url, regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '[^/]*$', 0) AS x FROM pages)""")
def ignore_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.array(*[F.lit(x) for x in ("# rules", "es/", " fr ", "!keep", "", "9*", "?[0-5]5")])
    name = tx.basename(F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/+$", ""))
    return table(spark, sf_dir, "pages").select(
        "page_id", "url", listing.ignored(name, listing.ignore_patterns(lines)).alias("ignored")
    )


@add(r"""
WITH f AS (SELECT 'p' || page_id AS id, html AS body, url AS path FROM pages
  UNION ALL SELECT 'd' || doc_id, text, source || '/' || doc_id || CASE lang WHEN 'en' THEN '.md' WHEN 'fr' THEN '.PY' WHEN 'de' THEN '.rst' ELSE '' END FROM documents)
SELECT id, CASE WHEN body = '' THEN NULL
   WHEN body LIKE '%PDF-%' AND starts_with(body, '%PDF-') THEN 'pdf'
   WHEN contains(body, chr(0)) THEN NULL ELSE 'text' END AS file_type,
 CASE WHEN path LIKE '%.md' THEN 'Markdown' WHEN path LIKE '%.PY' THEN 'Python' WHEN path LIKE '%.rst' THEN 'reStructuredText'
   ELSE 'text file' END AS language FROM f""")
def classify_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.create_map(*[F.lit(x) for x in ("en", ".md", "fr", ".PY", "de", ".rst")])
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("id"),
        F.col("text").alias("body"),
        F.concat("source", F.lit("/"), "doc_id", F.coalesce(F.element_at(suffix, F.col("lang")), F.lit(""))).alias("path"),
    )
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("body"), F.col("url").alias("path")
    )
    return pages.unionByName(docs).select(
        "id",
        file_type(F.encode("body", "UTF-8")).alias("file_type"),
        tx.language_hint(F.col("path")).alias("language"),
    )


# ---- text ---------------------------------------------------------------------------------------

CHUNK_SQL = r"""
RECURSIVE_CHUNKS AS (
  SELECT doc_id, 0 AS chunk_no, 0 AS pos, CUT(substr(text, 1, 900)) AS cut, length(text) AS n FROM documents WHERE text <> ''
  UNION ALL
  SELECT doc_id, chunk_no, np, np + CUT(substr(text, np + 1, 900)), n FROM (
    SELECT c.doc_id, c.chunk_no + 1 AS chunk_no, CASE WHEN c.cut - 200 <= c.pos THEN c.cut ELSE c.cut - 200 END AS np, d.text, c.n
    FROM RECURSIVE_CHUNKS c JOIN documents d USING (doc_id) WHERE c.cut < c.n))
"""


def _cut(arg: str) -> str:
    tries = ", ".join(
        f"nullif(length(regexp_extract({arg}, '(?s)^.*{p}', 0)), 0)" for p in tx.BREAKS
    )
    return f"coalesce({tries}, length({arg}))"


for _arg in ("substr(text, 1, 900)", "substr(text, np + 1, 900)"):
    CHUNK_SQL = CHUNK_SQL.replace(f"CUT({_arg})", _cut(_arg))
CHUNK_SQL = CHUNK_SQL.replace("RECURSIVE_CHUNKS", "spans")


@add(rf"""WITH RECURSIVE {CHUNK_SQL}
SELECT s.doc_id, s.chunk_no,
  CAST(length(substr(text, 1, pos)) - length(replace(substr(text, 1, pos), chr(10), '')) + 1 AS INTEGER) AS start_line,
  CAST(length(substr(text, 1, cut)) - length(replace(substr(text, 1, cut), chr(10), '')) + 1 AS INTEGER) AS end_line,
  CAST(cut - pos AS INTEGER) AS n_characters, md5(substr(text, pos + 1, cut - pos)) AS chunk_md5
FROM spans s JOIN documents d USING (doc_id)""")
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunking.boundary_chunks(docs, "text").select(
        "doc_id", "chunk_no", "start_line", "end_line",
        F.length("chunk_text").alias("n_characters"), F.md5("chunk_text").alias("chunk_md5"),
    )


@add(r"""
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS lines, length(text) AS n FROM documents),
s AS (SELECT doc_id, len(lines) AS n_lines, n, greatest(1, list_sum(list_transform(lines[1:100], lambda x: length(x))) // len(lines[1:100])) AS mean FROM t),
w AS (SELECT *, CASE WHEN greatest(1, n // 4) <= 512 THEN n_lines ELSE greatest(40, 2048 // mean) END AS size FROM s),
g AS (SELECT *, greatest(1, CAST(floor(size * 0.75) AS BIGINT)) AS step FROM w),
r AS (SELECT *, unnest(range(0, n_lines + 1)) AS k FROM g)
SELECT doc_id, CAST(k AS INTEGER) AS window_no, CAST(k * step + 1 AS INTEGER) AS first_line,
  CAST(least(n_lines, k * step + size) AS INTEGER) AS last_line
FROM r WHERE k = 0 OR (k - 1) * step + size < n_lines""")
def line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunking.line_windows(docs, "text", context_tokens=512).select(
        "doc_id", "window_no", "first_line", "last_line"
    )


_LINE_RANGES_SQL = """
t AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
t2 AS (SELECT *, len(lines) AS n_lines, [[1, (len(lines) + 3) // 4], [len(lines) // 2 + 1, len(lines)]] AS rs FROM t)
"""


def _line_ranges(n_lines):
    """Two ranges of a text: its first quarter and its second half."""
    return F.array(
        F.struct(F.lit(1).alias("start"), F.floor((n_lines + 3) / 4).cast("int").alias("end")),
        F.struct((F.floor(n_lines / 2) + 1).cast("int").alias("start"), n_lines.cast("int").alias("end")),
    )


@add(f"""WITH {_LINE_RANGES_SQL},
m AS (SELECT doc_id, text, lines, n_lines, CASE WHEN rs[2][1] <= rs[1][2] + 1 THEN [[1, n_lines]] ELSE rs END AS rs FROM t2),
o AS (SELECT doc_id, text, lines, n_lines, unnest(rs) AS r FROM m),
p AS (SELECT doc_id, text, r, list_sum([0] || list_transform(lines[1:r[1] - 1], lambda x: length(x) + 1)) AS a,
  least(length(text), list_sum(list_transform(lines[1:r[2]], lambda x: length(x) + 1))) AS b FROM o)
SELECT doc_id, string_agg(r[1] || '-' || r[2] || '@' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ' ' ORDER BY r[1]) AS located,
  md5(string_agg(substr(text, CAST(a AS BIGINT) + 1, CAST(b - a AS BIGINT)), '~' ORDER BY r[1])) AS slices_md5
FROM p GROUP BY doc_id""")
def line_char_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    merged = docs.withColumn("starts", chunking.line_starts("text")).withColumn(
        "ranges", chunking.merge_ranges(_line_ranges(F.size("starts")))
    )
    placed = merged.withColumn(
        "chars", chunking.char_ranges(F.col("ranges"), F.col("starts"), F.length("text"))
    )
    located = F.zip_with(
        "ranges", "chars",
        lambda r, c: F.concat_ws("", r["start"], F.lit("-"), r["end"], F.lit("@"), c["start"], F.lit(":"), c["end"]),
    )
    return placed.select(
        "doc_id",
        F.array_join(located, " ").alias("located"),
        F.md5(F.array_join(chunking.text_slices(F.col("text"), F.col("chars")), "~")).alias("slices_md5"),
    )


@add(f"""WITH {_LINE_RANGES_SQL},
b AS (SELECT doc_id, array_to_string(lines[1:rs[1][2]], chr(10)) AS b1, array_to_string(lines[rs[2][1]:rs[2][2]], chr(10)) AS b2 FROM t2),
c AS (SELECT doc_id, CASE WHEN length(b1) > 1800 THEN substr(b1, 1, 1800) || '...' ELSE b1 END AS e1, b2 FROM b),
d AS (SELECT doc_id, e1, b2, 1800 - length(e1) - 4 AS budget FROM c)
SELECT doc_id, md5(e1 || CASE WHEN budget <= 0 THEN '' ELSE chr(10) || '---' || chr(10) ||
  CASE WHEN length(b2) > budget THEN substr(b2, 1, budget) || '...' ELSE b2 END END) AS excerpt_md5 FROM d""")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    return docs.select(
        "doc_id", F.md5(chunking.excerpt(F.col("lines"), _line_ranges(F.size("lines")))).alias("excerpt_md5")
    )


@add(r"""
SELECT conv_id, turn, md5(array_to_string(list_transform(range(1, len(l) + 1),
   lambda i: CASE WHEN i < 1000000 THEN lpad(CAST(i AS VARCHAR), 6, ' ') ELSE CAST(i AS VARCHAR) END || '  ' || l[i]), chr(10))) AS prompt_md5,
  CASE WHEN length(text) <= 80 THEN text ELSE substr(text, 1, 77) || '...' END AS short,
  lower(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS title_key
FROM (SELECT *, string_split(text, chr(10)) AS l FROM conversations)""")
def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn",
        F.md5(tx.numbered_lines(F.col("text"))).alias("prompt_md5"),
        tx.shorten(F.col("text"), 80).alias("short"),
        tx.title_key(F.col("text")).alias("title_key"),
    )


@add("SELECT doc_id, md5(text || chr(10) || 'a' || chr(10) || chr(65533)) AS text_md5 FROM documents")
def decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with the line ends of other systems and a byte that is no UTF-8."""
    docs = table(spark, sf_dir, "documents")
    crlf = F.encode(F.concat(F.replace("text", F.lit("\n"), F.lit("\r\n")), F.lit("\ra\r\n")), "UTF-8")
    return docs.select("doc_id", F.md5(decode_text(F.concat(crlf, F.lit(b"\xff")))).alias("text_md5"))


@add(r"""
SELECT conv_id, turn, md5('Divide this ' || CASE role WHEN 'user' THEN 'Markdown' ELSE 'text file' END ||
  ' into topics. Answer with a JSON array of {"title", "summary", "ranges": [[first line, last line]]}. Topics may overlap or be made of several ranges.' || chr(10) || '---' || chr(10) ||
  array_to_string(list_transform(range(1, len(l) + 1), lambda i: lpad(CAST(i AS VARCHAR), 6, ' ') || '  ' || l[i]), chr(10))) AS prompt_md5
FROM (SELECT *, string_split(text, chr(10)) AS l FROM conversations)""")
def topic_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    language = tx.language_hint(F.concat(F.lit("/talk/"), F.when(F.col("role") == "user", "a.MD").otherwise("b.log")))
    return turns.select("conv_id", "turn", F.md5(text_prompt(F.col("text"), language)).alias("prompt_md5"))


@add(r"""
WITH c AS (SELECT conv_id, string_agg('[' || turn || '] ' || role || ' (pages ' || (turn + 1) || '-' || (turn + 2) || ')' || chr(10) || chr(10) || substr(text, 1, 400), chr(10) || chr(10) ORDER BY turn) AS body
  FROM conversations GROUP BY conv_id)
SELECT conv_id, md5('Rank the candidates for the question. Answer with a JSON array of {"id", "rank", "score", "reason"}.' || chr(10) || 'Question: talk ' || conv_id || chr(10) || '---' || chr(10) || body) AS prompt_md5 FROM c""")
def rank_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as questions, their turns as candidates."""
    pages = page_label(F.array((F.col("turn") + 1).cast("int"), (F.col("turn") + 2).cast("int")), "-", 100)
    entry = F.struct(
        F.col("turn").alias("id"), F.col("role").alias("title"), F.lit(None).cast("string").alias("summary"), pages.alias("pages"),
        F.substring("text", 1, 400).alias("excerpt"),
    )
    lists = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(entry)).alias("c"))
    question = F.concat(F.lit("talk "), F.col("conv_id").cast("string"))
    return lists.select("conv_id", F.md5(rank_prompt(question, F.col("c"))).alias("prompt_md5"))


# ---- page cache ---------------------------------------------------------------------------------

_CACHE_SQL = "e AS (SELECT doc_id, sha256(source) AS sha, doc_id AS page, n_chars AS bytes FROM documents)"


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as cached pages of their source, written in id order."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2("source", 256).alias("sha"), F.col("doc_id").alias("page"), F.col("n_chars").alias("bytes")
    )


@add(f"""WITH {_CACHE_SQL}
SELECT page, sha[1:2] || '/' || sha || '/' || page || '.webp' AS cache_path, bytes FROM e""")
def cache_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cache(spark, sf_dir).select(
        "page", cache.page_path(F.col("sha"), F.col("page")).alias("cache_path"), "bytes"
    )


@add(f"""WITH {_CACHE_SQL}, tot AS (SELECT sum(bytes) AS total FROM e),
r AS (SELECT doc_id, bytes, coalesce(sum(bytes) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS older FROM e)
SELECT doc_id, bytes, CAST(older AS BIGINT) AS older_bytes, total - older > total // 3 AS evict FROM r, tot""")
def lru_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _cache(spark, sf_dir)
    cap = F.floor(F.col("_total") / 3)
    return cache.lru_evictions(entries, ["doc_id"], F.floor(F.col("doc_id") / 256), cap).select(
        "doc_id", "bytes", "older_bytes", "evict"
    )


@add(f"""WITH {_CACHE_SQL}, gone AS (SELECT sha FROM e GROUP BY sha HAVING sum(bytes) > (SELECT sum(bytes) FROM e) / 20)
SELECT CAST(coalesce(sum(bytes), 0) AS BIGINT) AS size_bytes, count(*) AS n_entries FROM e WHERE sha NOT IN (SELECT sha FROM gone)""")
def cache_after_file_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _cache(spark, sf_dir)
    share = entries.groupBy("sha").agg(F.sum("bytes").alias("b"))
    mean = entries.agg((F.sum("bytes") / 20).alias("limit"))
    gone = share.join(F.broadcast(mean), F.col("b") > F.col("limit")).select("sha")
    return cache.cache_size(cache.evict_files(entries, gone))


@add("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CASE WHEN w <= 768 AND h <= 768 THEN w ELSE greatest(1, round_even(w * (CAST(768 AS DOUBLE) / greatest(w, h)), 0)) END AS INTEGER) AS width,
  CAST(CASE WHEN w <= 768 AND h <= 768 THEN h ELSE greatest(1, round_even(h * (CAST(768 AS DOUBLE) / greatest(w, h)), 0)) END AS INTEGER) AS height
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_partkey + 1 AS INTEGER) AS w, CAST(l_suppkey * 7 + 1 AS INTEGER) AS h FROM lineitem)""")
def downscaled_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_partkey") + 1).cast("int").alias("w"), (F.col("l_suppkey") * 7 + 1).cast("int").alias("h"),
    )
    width, height = tx.downscaled(F.col("w"), F.col("h"), 768)
    return sized.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", width.alias("width"), height.alias("height"))


# ---- ranges and titles --------------------------------------------------------------------------

@add("""
WITH r AS (SELECT DISTINCT l_suppkey, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS s,
   CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + floor(l_quantity / 10) AS INTEGER) AS e FROM lineitem),
m AS (SELECT *, max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r WHERE s <= e),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT l_suppkey, min(s) AS range_start, max(e) AS range_end FROM g GROUP BY l_suppkey, island""")
def range_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    ranges = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", day.alias("start"), (day + F.floor(F.col("l_quantity") / 10)).cast("int").alias("end")
    )
    return topics.merge_range_rows(ranges, ["l_suppkey"], F.floor(F.col("start") / 64))


@add("""
WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber AS p FROM lineitem),
g AS (SELECT l_orderkey, p, p - row_number() OVER (PARTITION BY l_orderkey ORDER BY p) AS island FROM d)
SELECT l_orderkey, min(p) AS run_start, max(p) AS run_end, max(p) - min(p) + 1 AS n_pages FROM g GROUP BY l_orderkey, island""")
def page_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("page"))
    return topics.page_runs(pages, ["l_orderkey"])


_TITLES_SQL = """
t AS (SELECT p_brand AS path, p_partkey AS ord, CASE WHEN p_size % 2 = 0 THEN upper(p_type) || '  ' ELSE lower(p_type) END AS title,
  p_name AS summary, p_size AS s, p_size + CAST(floor(p_retailprice) AS BIGINT) % 4 AS e FROM part),
k AS (SELECT *, lower(trim(title)) AS title_key FROM t)
"""


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("path"),
        F.col("p_partkey").alias("ord"),
        F.when(F.col("p_size") % 2 == 0, F.concat(F.upper("p_type"), F.lit("  "))).otherwise(F.lower("p_type")).alias("title"),
        F.col("p_name").alias("summary"),
        F.col("p_size").cast("long").alias("start"),
        (F.col("p_size") + F.floor("p_retailprice") % 4).alias("end"),
    )


@add(f"""WITH {_TITLES_SQL}
SELECT path, title_key, min_by(title, ord) AS title, min_by(summary, (-length(summary)) * 1000000000 + ord) AS summary, min(ord) AS first_ord
FROM k GROUP BY path, title_key""")
def title_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.coalesce_titles(_titles(spark, sf_dir))[0]


@add(f"""WITH {_TITLES_SQL}, u AS (SELECT DISTINCT path, title_key, s, e FROM k),
m AS (SELECT *, max(e) OVER (PARTITION BY path, title_key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM u),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY path, title_key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT path, title_key, CAST(min(s) AS BIGINT) AS range_start, max(e) AS range_end FROM g GROUP BY path, title_key, island""")
def title_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.coalesce_titles(_titles(spark, sf_dir))[1]
