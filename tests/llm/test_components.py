import glob

from pyspark.sql import functions as F

from quillfin.llm.components import components
from quillfin.session import checkpoint_dir


def _files(spark) -> int:
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return len(glob.glob(f"{folder}/**/part-*", recursive=True))


def test_rounds_over_few_edges_are_few_files(spark):
    """A chain takes several rounds; only the first is one file for each shuffle partition."""
    checkpoint_dir(spark)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        edges = spark.range(63).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
        before = _files(spark)
        found = components(edges).collect()
        made = _files(spark) - before
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, found)) == [(i, 0) for i in range(64)]
    assert 40 <= made < 2 * 40 + 40
