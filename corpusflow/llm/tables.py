"""What the operators of this package share: table access, the shared work folder, batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from corpusflow.session import work_dir

BATCH_ROWS = 1_500          # rows of an Arrow batch between the JVM and Python
BATCH_BYTES = "33554432"    # and its bytes, so that very long texts make smaller batches
PIECE_CHARS = 4_000_000     # bytes of text that one vectorised step works on


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, with Arrow batches of bounded size for what follows."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` doesn't have, whatever their case, for helper columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = f"_{stem}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a Parquet table below ``spark.checkpoint.dir`` and read again.

    This cuts the lineage at a copy that outlives lost executors. Zstandard keeps the copy small.
    """
    spark = df.sparkSession
    path = work_dir(spark, f"llm-{label}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, label: str) -> str:
    return work_dir(spark, f"llm-{label}")


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each, at least one row.

    After the last one, memory that Arrow keeps for later goes back: workers serve many tasks.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()
