"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the shared tables under ``sf_dir``, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``.

    A temporary folder is set only for a session on this machine alone without
    any (as in tests); on a cluster the setting must be there.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="wayfold-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate folder of this library, wherever its file system is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def ascii_lower(col: Column | str) -> Column:
    """A-Z in lower case; every other character stays."""
    return F.translate(F.col(col) if isinstance(col, str) else col, UPPER, LOWER)


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores added until no column of ``taken`` has it."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def in_bytes(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of ``batch`` whose ``column`` holds about ``most`` bytes.

    A slice has one row at least, so a row beyond ``most`` goes alone.
    """
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start, held = 0, 0
    for at, size in enumerate(sizes):
        if at > start and held + size > most:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size
    if len(sizes) > start:
        yield batch.slice(start)


def drawn(sizes: dict, sample: int) -> Column:
    """Whether a row (``label``, ``key``) is drawn: about ``sample`` of each label's keys, by a hash of the key.

    ``sizes`` holds the number of keys of each label; other labels are not drawn.
    """
    chosen = F.lit(False)
    for label, n in sizes.items():
        odds = (_draw() < int(sample / n * _DRAWS)) if n > sample else F.lit(True)
        chosen = F.when(F.col("label") == F.lit(label), odds).otherwise(chosen)
    return chosen


def in_budget(rows: DataFrame, most_bytes: int) -> list[Row]:
    """``label``, ``key``, ``text`` of drawn ``rows``: whole texts in the order of the draw until a label has ``most_bytes``.

    A label has one text at least.  Of rows that share a label and a key the least text counts.
    """
    once = rows.groupBy("label", "key").agg(F.min("text").alias("text")).where(F.col("text").isNotNull())
    before = Window.partitionBy("label").orderBy(_draw(), "key").rowsBetween(Window.unboundedPreceding, -1)
    held = once.withColumn("before", F.coalesce(F.sum(F.octet_length("text").cast("long")).over(before), F.lit(0)))
    return sorted(held.where(F.col("before") < most_bytes).select("label", "key", "text").collect(), key=lambda r: (str(r["key"]), r["text"]))


_DRAWS = 1 << 30


def _draw() -> Column:
    return F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(_DRAWS))
