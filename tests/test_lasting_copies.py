"""Copies of chunks and term vectors are most of what a read path writes, so they are kept small."""

from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from corpusflow.operators import chunking
from corpusflow.session import materialize
from corpusflow.sources.indexes import lasting


def test_lasting_and_passing_copies_are_compressed_alike(spark, tmp_path):
    source = str(tmp_path / "in.parquet")
    spark.range(50).write.parquet(source)
    rows = spark.read.parquet(source).select("id", F.repeat(F.lit("chunk "), 100).alias("text"))
    kept = lasting(spark, "copies", (chunking,), source)(lambda: rows, "rows")
    for df in (kept, materialize(rows, "rows")):
        assert sorted(map(tuple, df.collect())) == [(i, "chunk " * 100) for i in range(50)]
        codecs = {pq.ParquetFile(Path(f.removeprefix("file:"))).metadata.row_group(0).column(1).compression for f in df.inputFiles()}
        assert codecs == {"ZSTD"}
