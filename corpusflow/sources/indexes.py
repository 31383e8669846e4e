"""Lasting tables: what is derived from an input is written once and found again while the input's files stay the same."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from pathlib import Path
from types import ModuleType

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.session import shared_dir


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """A digest of names, sizes and times of all files below the paths. Contents aren't read, and one row comes to the driver."""
    files = None
    for p in paths:
        f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(p).select("path", "length", "modificationTime")
        files = f if files is None else files.unionByName(f)
    h = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    row = files.agg(F.count("*"), F.coalesce(F.sum(h), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()
    return f"{row[0]}-{row[2]}-{int(row[1]) & (1 << 64) - 1:016x}"


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def lasting(spark: SparkSession, name: str, by: tuple[ModuleType, ...], *paths: str) -> Callable[[Callable[[], DataFrame], str], DataFrame]:
    """``keep(make, label)``: the table that ``make()`` gives, from the shared work folder if it was written there from the same files before.

    ``name`` and the code of the modules ``by`` stand for how the table is made. A table counts as written once the marker behind it is there, so one that
    breaks off is made again.
    """
    code = zlib.crc32(b"".join(Path(m.__file__).read_bytes() for m in by))
    base = f"{shared_dir(spark)}/corpusflow/lasting/{name}-{code:08x}-{fingerprint(spark, *paths)}"

    def keep(make: Callable[[], DataFrame], label: str) -> DataFrame:
        path, marker = f"{base}/{label}", f"{base}/{label}-done"
        if _table(spark, marker) is None:
            make().write.mode("overwrite").option("compression", "zstd").parquet(path)
            spark.range(1).write.mode("overwrite").parquet(marker)
        return spark.read.parquet(path)

    return keep
