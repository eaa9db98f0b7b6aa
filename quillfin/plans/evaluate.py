"""Grading retrieval results, summarising grades, comparing reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reported metrics and the direction that counts as better.
METRICS = {
    "p_at_1": "higher",
    "p_at_5": "higher",
    "p_at_10": "higher",
    "mrr": "higher",
    "semantic_at_5": "higher",
    "avg_distinct_pages_top10": "higher",
    "avg_query_wall_s": "lower",
    "index_wall_s": "lower",
}


def result_pages(page_refs: Column, page: Column) -> Column:
    """Pages of a result: its page refs, or its single page, or none."""
    single = F.when(page.isNotNull(), F.array(page)).otherwise(F.array().cast("array<int>"))
    return F.when(F.coalesce(F.size(page_refs), F.lit(0)) > 0, page_refs).otherwise(single)


def grade(results: DataFrame, questions: DataFrame) -> DataFrame:
    """One grade row per question, also for questions without results.

    ``questions``: ``query_id, lo, hi, must_contain_any array<string>, difficulty``. A result hits if
    any of its pages lies in [lo, hi]. The reciprocal rank looks at all results; the phrase check at
    the texts of the first five.
    """
    joined = results.join(questions.select("query_id", "lo", "hi"), "query_id").withColumn(
        "pages", result_pages(F.col("page_refs"), F.col("page"))
    )
    hit = F.exists("pages", lambda p: (p >= F.col("lo")) & (p <= F.col("hi")))
    text = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    top5 = F.when(
        F.col("rank") <= 5,
        F.struct("rank", text("excerpt").alias("excerpt"), F.concat(F.lit(" "), text("title"), F.lit(" "), text("summary")).alias("more")),
    )
    graded = joined.withColumn("hit", hit).groupBy("query_id").agg(
        F.max(F.col("hit") & (F.col("rank") <= 1)).alias("top1"),
        F.max(F.col("hit") & (F.col("rank") <= 5)).alias("top5"),
        F.max(F.col("hit") & (F.col("rank") <= 10)).alias("top10"),
        F.min(F.when(F.col("hit"), F.col("rank"))).alias("first_hit"),
        F.sort_array(F.collect_list(top5)).alias("texts"),
        F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("rank") <= 10, F.col("pages")))))).alias("n_pages"),
    )
    corpus = F.concat(
        F.array_join(F.transform("texts", lambda t: t["excerpt"]), " "),
        F.array_join(F.transform("texts", lambda t: t["more"]), ""),
    )
    found = F.exists("must_contain_any", lambda m: F.contains(corpus, F.lower(m)))
    no = F.lit(False)
    return questions.join(graded, "query_id", "left").select(
        "query_id",
        "difficulty",
        F.coalesce("top1", no).alias("top1"),
        F.coalesce("top5", no).alias("top5"),
        F.coalesce("top10", no).alias("top10"),
        F.coalesce(1 / F.col("first_hit"), F.lit(0.0)).alias("mrr"),
        F.coalesce(found, no).alias("semantic5"),
        F.coalesce("n_pages", F.lit(0)).alias("distinct_pages_top10"),
    )


def summarise(grades: DataFrame) -> DataFrame:
    """Means to four decimals, over everything (``difficulty`` null) and per difficulty present."""

    def mean(c: str) -> Column:
        return F.round(F.avg(F.col(c).cast("double")), 4)

    return grades.rollup("difficulty").agg(
        F.count("*").alias("n"),
        mean("top1").alias("p_at_1"),
        mean("top5").alias("p_at_5"),
        mean("top10").alias("p_at_10"),
        mean("mrr").alias("mrr"),
        mean("semantic5").alias("semantic_at_5"),
        mean("distinct_pages_top10").alias("avg_distinct_pages_top10"),
    )


def metric_rows(summary: DataFrame) -> DataFrame:
    """A one-row summary as ``(metric, value)`` rows."""
    present = [m for m in METRICS if m in summary.columns]
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in present])
    return summary.select(F.explode(pairs).alias("p")).select("p.*")


def _known(spark) -> DataFrame:
    return spark.createDataFrame(list(METRICS.items()), "metric string, direction string")


def report_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both reports side by side: ``metric, a, b, delta, better, regression``; missing values are 0.

    A regression is a drop of the phrase metric by more than 1e-6.
    """
    left = a.select("metric", F.col("value").alias("a"))
    right = b.select("metric", F.col("value").alias("b"))
    both = left.join(right, "metric", "full_outer")
    rows = _known(a.sparkSession).join(both, "metric", "left")
    va, vb = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    delta = vb - va
    return rows.select(
        "metric",
        va.alias("a"),
        vb.alias("b"),
        delta.alias("delta"),
        F.when(F.col("direction") == "higher", delta >= 0).otherwise(delta <= 0).alias("better"),
        ((F.col("metric") == "semantic_at_5") & (delta < -1e-6)).alias("regression"),
    )


def report_matrix(reports: dict[str, DataFrame]) -> DataFrame:
    """Metric x report matrix; missing values are 0."""
    parts = [df.withColumn("report", F.lit(name)) for name, df in reports.items()]
    stacked = reduce(DataFrame.unionByName, parts)
    wide = stacked.groupBy("metric").pivot("report", list(reports)).agg(F.first("value"))
    return wide.select("metric", *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in reports])


def run_checks(results: DataFrame, skipped: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, passed, total`` of the expectations a validation query states.

    ``queries``: ``query_id, min_results, expected_paths_contain array<string>, expect_skipped``. The
    path check passes if any result path contains any expected part.
    """
    wanted = queries.select("query_id", "expected_paths_contain")
    counts = results.join(wanted, "query_id").groupBy("query_id").agg(
        F.count("*").alias("got"),
        F.max(F.exists("expected_paths_contain", lambda x: F.contains("path", x))).alias("matched"),
    )
    skips = skipped.groupBy("query_id").agg(F.count("*").alias("n_skipped"))
    joined = queries.join(counts, "query_id", "left").join(skips, "query_id", "left")
    has_paths = F.size(F.coalesce("expected_paths_contain", F.array().cast("array<string>"))) > 0
    has_skip = F.coalesce("expect_skipped", F.lit(False))
    enough = F.coalesce("got", F.lit(0)) >= F.coalesce("min_results", F.lit(0))
    return joined.select(
        "query_id",
        (
            enough.cast("int")
            + (has_paths & F.coalesce("matched", F.lit(False))).cast("int")
            + (has_skip & (F.coalesce("n_skipped", F.lit(0)) > 0)).cast("int")
        ).alias("passed"),
        (F.lit(1) + has_paths.cast("int") + has_skip.cast("int")).alias("total"),
    )


def totals(checks: DataFrame) -> DataFrame:
    return checks.agg(F.sum("passed").alias("passed"), F.sum("total").alias("total"))


def diff_table(diff: DataFrame, name_a: str = "a", name_b: str = "b") -> DataFrame:
    """Markdown lines of a report diff in the order of ``METRICS``: ``line_no, line``."""
    spark = diff.sparkSession
    head = spark.createDataFrame(
        [(0, f"| Metric | {name_a} | {name_b} | Δ |"), (1, "|---|---:|---:|---:|")], "line_no int, line string"
    )
    place = F.create_map(*[F.lit(x) for i, m in enumerate(METRICS) for x in (m, i + 2)])
    body = diff.select(
        F.element_at(place, F.col("metric")).alias("line_no"),
        F.format_string(
            "| %s | %.3f | %.3f | %s%.3f %s |", "metric", "a", "b", F.when(F.col("delta") >= 0, "+").otherwise(""), "delta",
            F.when(F.col("better"), "✓").otherwise("✗"),
        ).alias("line"),
    )
    return head.unionByName(body).orderBy("line_no")


def load_queries(spark, path: str) -> DataFrame:
    """Validation queries from a JSON or YAML file with a top-level ``queries`` list.

    Every query needs ``id``, ``query`` and ``paths``.
    """
    import json

    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        raw = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as exc:
            raise RuntimeError("reading YAML queries needs PyYAML") from exc
        raw = yaml.safe_load(text)
    listed = raw.get("queries") if isinstance(raw, dict) else None
    if not isinstance(listed, list):
        raise ValueError(f"{path} has no list of queries")
    for n, q in enumerate(listed):
        missing = [k for k in ("id", "query", "paths") if k not in q]
        if missing:
            raise ValueError(f"query {n} in {path} lacks {', '.join(missing)}")
    rows = [
        (q["id"], q["query"], q["paths"], q.get("min_results", 0), q.get("expected_paths_contain", []), bool(q.get("expect_skipped", False)))
        for q in listed
    ]
    return spark.createDataFrame(
        rows,
        "query_id string, query string, paths array<string>, min_results int, expected_paths_contain array<string>, expect_skipped boolean",
    )
