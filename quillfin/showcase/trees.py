"""Files on disk: the rows of ``pages`` and ``documents`` written as a tree, then listed and read."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfin.settings import Settings
from quillfin.showcase import Showcase, table
from quillfin.showcase.store import scratch
from quillfin.sources import files as fs
from quillfin.sources import splits

shown = Showcase()
add = shown.add


def _local(uri: str) -> str:
    return uri.removeprefix("file://").removeprefix("file:")


def _written(rows: DataFrame, root: str) -> DataFrame:
    """``name, body, link`` rows as files below ``root``, with links to them where ``link`` names one; gives path and size."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, body, link in zip(frame["name"], frame["body"], frame["link"]):
                path, data = f"{root}/{name}", (body or "").encode()
                os.makedirs(os.path.dirname(path), exist_ok=True)
                # A task that runs again writes the same file.
                with open(f"{path}.part", "wb") as f:
                    f.write(data)
                os.replace(f"{path}.part", path)
                if link and not os.path.islink(f"{root}/{link}"):
                    os.symlink(path, f"{root}/{link}")
                out.append((path, len(data)))
            yield pd.DataFrame(out, columns=["path", "size"])

    return rows.select("name", "body", "link").mapInPandas(write, "path string, size bigint").checkpoint()


# Every eleventh page is a hidden file, every folder has a config file, every thirteenth page has a link.
_NAME = "'d' || page_id % 7 || '/' || CASE WHEN page_id % 11 = 0 THEN '.' ELSE '' END || 'p' || page_id || '.html'"


@add(
    f"""SELECT {_NAME} AS path, NULL AS reason FROM pages WHERE page_id % 11 <> 0 AND page_id NOT IN (SELECT min(page_id) FROM pages WHERE page_id % 11 <> 0 GROUP BY page_id % 7)
    UNION ALL SELECT {_NAME}, 'symlink' FROM pages WHERE page_id % 13 = 0 AND page_id NOT IN (SELECT min(page_id) FROM pages WHERE page_id % 11 <> 0 GROUP BY page_id % 7)"""
)
def walked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a tree and what a walk that follows no links leaves out, with the reason."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    hidden = F.when(F.col("page_id") % 11 == 0, ".").otherwise("")
    folder = F.format_string("d%d", F.col("page_id") % 7)
    first = pages.where("page_id % 11 <> 0").groupBy((F.col("page_id") % 7).alias("_d")).agg(F.min("page_id").alias("_first"))
    configs = pages.join(F.broadcast(first), F.col("page_id") == F.col("_first"), "left")
    page = F.concat(folder, F.lit("/"), hidden, F.format_string("p%d.html", F.col("page_id")))
    # The first page of a folder is written under the name of a config file.
    name = F.when(F.col("_first").isNotNull(), F.concat(folder, F.lit("/quillfin.json"))).otherwise(page)
    link = F.when((F.col("page_id") % 13 == 0) & F.col("_first").isNull(), F.format_string("d%d/link%d.html", F.col("page_id") % 7, F.col("page_id")))
    root = _local(scratch(spark, "tree"))
    _written(configs.select(name.alias("name"), F.col("html").alias("body"), link.alias("link")), root)
    files, skipped = fs.walk(spark, [root, f"{root}/d1"], Settings(follow_symlinks=False))
    found = files.select("path", F.lit(None).cast("string").alias("reason")).unionByName(skipped)
    return found.select(F.substring("path", len(root) + 2, 1 << 20).alias("path"), "reason")


@add(
    r"""WITH whole AS (SELECT doc_id, string_split(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS lines FROM documents),
    line AS (SELECT doc_id, unnest(lines) AS text, generate_subscripts(lines, 1) AS line_no FROM whole),
    placed AS (SELECT *, CAST(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS past FROM line)
    SELECT 't/' || doc_id || '.txt' AS path, CAST(line_no AS BIGINT) AS line_no, past - length(text) - 1 AS char_start, past - 1 AS char_end, md5(text) AS text_md5 FROM placed"""
)
def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of text files with their places, read in splits of 777 bytes."""
    docs = table(spark, sf_dir, "documents").select(F.format_string("t/%d.txt", F.col("doc_id")).alias("name"), F.col("text").alias("body"), F.lit(None).cast("string").alias("link"))
    root = _local(scratch(spark, "texts"))
    lines = splits.text_lines(_written(docs, root), 777)
    return lines.select(F.substring("path", len(root) + 2, 1 << 20).alias("path"), "line_no", "char_start", "char_end", F.md5("text").alias("text_md5"))
