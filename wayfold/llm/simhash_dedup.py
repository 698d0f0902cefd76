"""SimHash near-duplicates by segment popcounts.

A fingerprint's bit is 1 if it is set in over half the XXH64 hashes (seed 42)
of the text's three-word shingles.  Fingerprints link at two differing bits or
fewer.

Search: a fingerprint is embedded as the popcounts of its segments, of
``WIDTHS[0]`` bits each.  Two differing bits move that vector by at most two in
Manhattan distance, so two linked vectors have a grid point within one step of
both.  Each distinct fingerprint goes to its own point and its neighbours (33 at
most), pairs that meet at a point are verified bit by bit, and copies of a
fingerprint never enter the join.

A point with more than ``POINT`` fingerprints is split instead of paired off:
its fingerprints go through the same search with narrower segments, which tell
more vectors apart (65 points each).  With segments of one bit the vector is the
fingerprint itself: whatever meets at a point there is within one bit of it and
so linked, and linking all of it to its least fingerprint keeps every link's
component with one row for each.  Two linked fingerprints that share a point of
one width either are paired there or go on together, so no link is lost and no
group is paired off, whatever its size.

Components are found by alternating star contraction over the links, with a
reliable checkpoint for each round; nothing of the corpus goes to the driver.

Cases: null and wordless texts have fingerprint zero and link like any other.
Rows that repeat or share an id each return a row.  ``component_id`` is the
smallest id that is reachable; null ids have none themselves, and a component
of only null ids has a null ``component_id``.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.llm.common import checkpointed, fresh, in_bytes, table
from wayfold.operators.components import connected_components

SHINGLE = 3
SEED = 42
BITS = 2
#: Bits of a segment, and bits that its popcount takes in a packed vector: whole fingerprints in 64 bits.
WIDTHS, PACKED = (4, 2, 1), {4: 3, 2: 2}
POINT = 32
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_PLACES = np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of one text, unsigned."""
    import xxhash

    words = (text or "").encode().translate(_LOWER).split()  # at exactly the six blanks
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(words) - SHINGLE + 1)
    last = ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        ones += np.unpackbits(hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * ones > n).astype(np.uint64) << _PLACES).sum(dtype=np.uint64))


def fingerprints(documents: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fp (the fingerprint as a signed long) for each row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in in_bytes(whole, "text"):
                found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
                yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], names=["key", "fp"])

    source = documents.select(documents[key].alias("key"), documents[text].alias("text"))
    return source.mapInArrow(run, f"key {source.schema['key'].dataType.simpleString()}, fp long")


def _points(distinct: DataFrame, width: int) -> DataFrame:
    """fp, point, step (0: its own point, else which neighbour) for segments of ``width`` bits."""
    own, one = F.col("fp"), F.lit(1).cast("long")
    if width == 1:
        near = F.array(own, *[own.bitwiseXOR(F.shiftleft(one, bit)) for bit in range(64)])
        return distinct.select("fp", F.posexplode(near).alias("step", "point")).select("fp", "point", "step")
    segments, bits = 64 // width, PACKED[width]
    counts = F.array(*[F.bit_count(F.shiftrightunsigned(own, width * s).bitwiseAND(F.lit(2**width - 1))).cast("long") for s in range(segments)])
    placed = distinct.select("fp", counts.alias("counts"))
    count = [F.get("counts", F.lit(s)) for s in range(segments)]
    home = reduce(Column.bitwiseOR, [F.shiftleft(count[s], bits * s) for s in range(segments)])
    steps = [F.struct(F.col("home").alias("point"), F.lit(0).alias("step"))]
    for s in range(segments):
        for sign in (1, -1):
            moved = F.col("home").bitwiseXOR(F.shiftleft(count[s].bitwiseXOR(count[s] + sign), bits * s))
            steps.append(F.when((count[s] < width) if sign > 0 else (count[s] > 0), F.struct(moved.alias("point"), F.lit(sign * (s + 1)).alias("step"))))
    return (
        placed.select("fp", "counts", home.alias("home"))
        .select("fp", F.explode(F.array_compact(F.array(*steps))).alias("at"))
        .select("fp", F.col("at.point").alias("point"), F.col("at.step").alias("step"))
    )


def links(distinct: DataFrame, point: int = POINT) -> DataFrame:
    """a, b: linked fingerprints, or a chain of links of linked ones; every component is connected by them.

    ``distinct`` has one row for each fingerprint ``fp``.
    """
    parts, left = [], distinct.select("fp")
    for width in WIDTHS[:-1]:
        points = _points(left, width)
        loads = points.groupBy("point").agg(F.count(F.lit(1)).alias("load")).where("load > 1")
        shared = checkpointed(points.join(loads, "point").select("fp", "point", "step", "load"))
        few = shared.where(F.col("load") <= point)
        a = few.select("point", F.col("fp").alias("a"), F.col("step").alias("a_step"))
        b = few.select("point", F.col("fp").alias("b"), F.col("step").alias("b_step"))
        # Equal vectors share all their points: they count at their own.
        once = (F.col("a_step") != F.col("b_step")) | (F.col("a_step") == 0)
        parts.append(a.join(b, "point").where((F.col("a") < F.col("b")) & once & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS)).select("a", "b"))
        left = checkpointed(shared.where(F.col("load") > point).select("fp").distinct())
        if left.isEmpty():
            break
    else:
        points = _points(left, 1)
        least = points.groupBy("point").agg(F.min("fp").alias("b"), F.max("fp").alias("most")).where("b < most").select("point", "b")
        parts.append(points.join(least, "point").where("fp <> b").select(F.col("fp").alias("a"), "b"))
    return reduce(DataFrame.unionAll, parts).distinct()


def components(documents: DataFrame, *, key: str = "doc_id", text: str = "text", point: int = POINT) -> DataFrame:
    """key, fp, root (the component's least fingerprint) and component_id for each row."""
    prints = checkpointed(fingerprints(documents, key=key, text=text))
    distinct = checkpointed(prints.groupBy("fp").agg(F.min("key").alias("least")))
    roots = connected_components(links(distinct.select("fp"), point), checkpoint=checkpointed)
    own = distinct.join(roots.select(F.col("node").alias("fp"), F.col("component").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = own.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = own.join(least, "root").select("fp", "root", "component_id")
    return prints.join(labels, "fp").select("key", "fp", "root", "component_id")


def near_duplicates(documents: DataFrame, *, key: str = "doc_id", text: str = "text", point: int = POINT) -> DataFrame:
    """key, fingerprint (16 hexadecimal digits), component_id for each row."""
    found = components(documents, key=key, text=text, point=point)
    return found.select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(documents: DataFrame, *, key: str = "doc_id", text: str = "text", point: int = POINT) -> DataFrame:
    """One document of each component, all columns kept: the one with the least id.

    Rows are told apart by id and fingerprint: of rows that share the least id
    one with the least fingerprint stays, and a component of only null ids
    keeps one row.
    """
    found = components(documents, key=key, text=text, point=point)
    fp, root = fresh("_kept_fp", documents.columns), fresh("_kept_root", documents.columns)
    kept_key, kept = fresh("_kept_key", documents.columns), fresh("_kept", documents.columns)
    named = found.where(F.col("key").isNotNull()).groupBy("root").agg(F.min(F.struct("key", "fp")).alias("m"))
    keys = named.select(F.col("m.key").alias(kept_key), F.col("m.fp").alias(fp))
    known = fingerprint_column(documents.where(documents[key].isNotNull()), text, kept)
    # a pair of id and fingerprint lies in one component
    with_id = known.join(keys, (known[key] == keys[kept_key]) & (known[kept] == keys[fp]), "left_semi").dropDuplicates([key, kept])
    lone = found.where(F.col("component_id").isNull()).select(F.col("fp").alias(fp), F.col("root").alias(root)).distinct()
    mapped = fingerprint_column(documents.where(documents[key].isNull()), text, kept)
    without = mapped.join(lone, mapped[kept] == lone[fp]).dropDuplicates([root])
    return with_id.select(*documents.columns).unionByName(without.select(*documents.columns))


def fingerprint_column(documents: DataFrame, text: str, name: str) -> DataFrame:
    """``documents`` with the fingerprint of ``text`` as column ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in in_bytes(whole, text):
                found = np.array([fingerprint(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()], np.uint64)
                yield batch.append_column(name, pa.array(found.view(np.int64)))

    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, T.StructField(name, T.LongType())]))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
