"""Benchmark decontamination by winnowing word k-grams, in DataFrame functions only.

A document word is hit if it lies in an occurrence of a benchmark *window*:
ten consecutive words of an item, or the whole item if it has fewer.

Winnowing: of the six 5-grams in every ten-word window the one with the least
hash is kept (the last of equal ones), once for all windows that keep it: about
two of seven.  Both sides keep the same ones of a shared window, so every shared
span of ten words or more has a kept 5-gram in common.  Documents meet the
benchmark on kept hashes alone; a met 5-gram is then extended word by word, up
to five words to each side, and is a hit if ten words in a row are equal.  No
hash decides.  Items of fewer than ten words meet on the hash of the whole item.

Plan: words are hashed once for each document, and its kept 5-grams are chosen
in one pass over that array; only (document, position, hash) of those leaves the
row.  The benchmark's fingerprints are broadcast if their count is at most
``broadcast_windows``, else both sides are joined by shuffle on the hash.  Only
the texts of documents that meet something are then fetched for the extension,
by a join on their id and text hash.  One small row for each document is joined
with its hits.

Cases: null or wordless texts have no words and no hits.  Items without words
or with null texts have no windows.  Items that share an ``item_id`` count
once, an item without an id counts in ``n_hit`` and not in ``n_items``.
Repeated document rows each return a row; rows may share a ``doc_id`` or have
none.  Other columns are ignored.  An empty benchmark hits nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import ascii_lower, checkpointed, fresh, table

WINDOW = 10
GRAM = 5
#: Characters that part words, before A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: About 300 bytes each: 60 MB of broadcast at most.
BROADCAST_WINDOWS = 200_000
#: Documents that hit something, 40 bytes each: 40 MB of broadcast at most.
BROADCAST_DOCUMENTS = 1_000_000

RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _word_hash(word: Column) -> Column:
    """Equal for words that are equal once lower-cased, and cheap on whole arrays."""
    return F.xxhash64(F.lower(word))


def _words(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), SEPARATORS)


def _prepared(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, words (raw, edges may be empty strings), hashes, n_words."""
    return (
        df.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("text_hash"), _words(text).alias("words"))
        .withColumn("hashes", F.transform("words", _word_hash))
        .withColumn(
            "n_words",
            F.size("words")
            - F.when(F.col("words")[0] == "", 1).otherwise(0)
            - F.when((F.size("words") > 1) & (F.element_at("words", -1) == ""), 1).otherwise(0),
        )
    )


def _with_grams(words: DataFrame) -> DataFrame:
    """... and grams: the hashes of all 5-grams, in order."""
    places = F.when(F.size("hashes") >= GRAM, F.sequence(F.lit(0), F.size("hashes") - GRAM)).otherwise(F.array().cast("array<int>"))
    return words.withColumn("grams", F.transform(places, lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(GRAM)])))


def _kept() -> Column:
    """(need, at, met) of every 5-gram that a window keeps."""
    reach = WINDOW - GRAM

    def run(i: Column, side: int, n: int = 1) -> Column:
        """How many 5-grams in a row are greater than that at ``i`` (on the left: or equal)."""
        own, other = F.get("grams", i), F.get("grams", i + side * n)
        beyond = other >= own if side < 0 else other > own
        return F.when(beyond, F.lit(1) + (run(i, side, n + 1) if n < reach else F.lit(0))).otherwise(F.lit(0))

    places = F.when(F.size("grams") > reach, F.sequence(F.lit(0), F.size("grams") - 1)).otherwise(F.array().cast("array<int>"))
    chosen = F.filter(places, lambda i: run(i, -1) + run(i, 1) >= reach)
    return F.transform(chosen, lambda i: F.struct(F.lit(WINDOW).alias("need"), i.alias("at"), F.get("grams", i).alias("met")))


def _runs(length: int) -> Column:
    """(need, at, met) of every run of ``length`` words."""
    places = F.when(F.size("hashes") >= length, F.sequence(F.lit(0), F.size("hashes") - length)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(F.lit(length).alias("need"), i.alias("at"), F.xxhash64(*[F.get("hashes", i + k) for k in range(length)]).alias("met")))


def _fingerprints(items: DataFrame, short: list[int]) -> DataFrame:
    """Of the benchmark: met (the hash), around (words), lead (how many before the gram), gram and need (lengths), item."""
    first = F.when(F.col("words")[0] == "", 1).otherwise(0)
    spoken = items.select("key", "n_words", F.slice("words", first + 1, F.col("n_words")).alias("words"), F.slice("hashes", first + 1, F.col("n_words")).alias("hashes"))
    item, at = F.col("key").cast("string").alias("item"), F.col("p.at")
    lead = F.least(at, F.lit(WINDOW - GRAM))
    around = F.transform(F.slice("words", at - lead + 1, lead + WINDOW), ascii_lower)
    long = _with_grams(spoken.where(F.col("n_words") >= WINDOW)).select("key", "words", F.explode(_kept()).alias("p"))
    parts = [long.select(F.col("p.met").alias("met"), around.alias("around"), lead.alias("lead"), F.lit(GRAM).alias("gram"), F.lit(WINDOW).alias("need"), item)]
    for n in short:
        whole = spoken.where(F.col("n_words") == n).select("key", "words", F.explode(_runs(n)).alias("p"))
        parts.append(whole.select(F.col("p.met").alias("met"), F.transform("words", ascii_lower).alias("around"), F.lit(0).alias("lead"), F.lit(n).alias("gram"), F.lit(n).alias("need"), item))
    return reduce(DataFrame.unionAll, parts).distinct()


def _probes(prepared: DataFrame, short: list[int]) -> DataFrame:
    """Of documents: need, at and met of every kept 5-gram, and of every run as long as a short item."""
    every = F.concat(_kept(), *[_runs(n) for n in short])
    return _with_grams(prepared).select("key", "text_hash", F.explode(every).alias("p")).select("key", "text_hash", "p.*")


def _extended(met: DataFrame) -> DataFrame:
    """key, text_hash, lo, hi (first and last equal word), item of the hits among met 5-grams."""
    here = F.transform("around", lambda w, i: F.coalesce(w == ascii_lower(F.get("words", F.col("at") - F.col("lead") + i)), F.lit(False)))

    def equal(part: Column) -> Column:
        """How many flags from the front on are true."""
        stop = F.array_position(part, F.lit(False)).cast("int")
        return F.when(stop == 0, F.size(part)).otherwise(stop - 1)

    flags = met.withColumn("equal", here).withColumns(
        {
            "own": equal(F.slice("equal", F.col("lead") + 1, F.col("gram"))),
            "left": equal(F.reverse(F.slice("equal", F.lit(1), F.col("lead")))),
            "right": equal(F.slice("equal", F.col("lead") + F.col("gram") + 1, F.lit(WINDOW))),
        }
    )
    found = flags.where((F.col("own") == F.col("gram")) & (F.col("left") + F.col("gram") + F.col("right") >= F.col("need")))
    return found.select("key", "text_hash", (F.col("at") - F.col("left")).alias("lo"), (F.col("at") + F.col("gram") + F.col("right") - 1).alias("hi"), "item")


def hits(documents: DataFrame, benchmark: DataFrame, *, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """key, text_hash, lo, hi, item: runs of ten words or more (or a whole short item) that documents share with items."""
    items = _prepared(benchmark, item_key, item_text)
    short = sorted(r[0] for r in items.where(F.col("n_words").between(1, WINDOW - 1)).select("n_words").distinct().collect())
    prints, prepared = _fingerprints(items, short), _prepared(documents, doc_key, doc_text)
    side = F.broadcast(prints) if prints.count() <= broadcast_windows else prints
    met = checkpointed(_probes(prepared, short).join(side, ["need", "met"]))
    wanted = met.select(F.col("key").alias("_key"), F.col("text_hash").alias("_hash")).distinct()
    rows = documents.select(documents[doc_key].alias("key"), documents[doc_text].alias("text")).withColumn("text_hash", F.xxhash64("text"))
    own = rows.join(_sized(wanted), rows["key"].eqNullSafe(F.col("_key")) & (rows["text_hash"] == F.col("_hash")), "left_semi")
    words = own.dropDuplicates(["key", "text_hash"]).select(F.col("key").alias("_key"), F.col("text_hash").alias("_hash"), _words("text").alias("words"))
    return _extended(met.join(words, met["key"].eqNullSafe(F.col("_key")) & (met["text_hash"] == F.col("_hash"))))


def _sized(found: DataFrame) -> DataFrame:
    """``found``, broadcast if it is small."""
    return F.broadcast(found) if found.count() <= BROADCAST_DOCUMENTS else found


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, doc_key: str = "doc_id", doc_text: str = "text", **names) -> DataFrame:
    """One row for each document row: ``RESULT`` with ``doc_key`` for doc_id."""
    spans = F.transform("spans", lambda h: F.sequence(h["lo"], h["hi"]))
    by = (
        hits(documents, benchmark, doc_key=doc_key, doc_text=doc_text, **names)
        .groupBy("key", "text_hash")
        .agg(F.collect_set(F.struct("lo", "hi")).alias("spans"), F.collect_set("item").alias("items"))
        .select(F.col("key").alias("_key"), F.col("text_hash").alias("_hash"), F.size(F.array_distinct(F.flatten(spans))).alias("hit"), F.array_sort("items").alias("items"))
    )
    every = _prepared(documents, doc_key, doc_text).select("key", "text_hash", "n_words")
    joined = every.join(by, every["key"].eqNullSafe(F.col("_key")) & (every["text_hash"] == F.col("_hash")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        F.col("key").alias(doc_key),
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        F.col("hit").isNotNull().alias("contaminated"),
    )


def clean(documents: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """The documents without a benchmark window, all columns kept.

    Rows that share a ``doc_id`` and a text are kept or dropped together;
    documents are told apart by id and text hash, so ids may repeat or be null.
    """
    key, text = names.get("doc_key", "doc_id"), names.get("doc_text", "text")
    id_, hash_ = fresh("_hit_id", documents.columns), fresh("_hit_hash", documents.columns)
    found = checkpointed(hit_documents(documents, benchmark, **names)).select(F.col("key").alias(id_), F.col("text_hash").alias(hash_))
    on = documents[key].eqNullSafe(F.col(id_)) & (F.xxhash64(documents[text]) == F.col(hash_))
    return documents.join(_sized(found), on, "left_anti")


def hit_documents(documents: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """key and text_hash of the documents with a benchmark window, each once."""
    return hits(documents, benchmark, **names).select("key", "text_hash").distinct()


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bp AS (
  SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS pos
  FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, pos, pos + n - 1), ' ') AS s FROM bp),
lengths AS (SELECT DISTINCT n FROM bw),
dp AS (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS pos
  FROM d, lengths WHERE len(w) >= n),
dw AS (SELECT r, n, pos, array_to_string(list_slice(w, pos, pos + n - 1), ' ') AS s FROM dp),
hit AS (SELECT r, dw.n, pos, item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(pos, pos + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
        FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN its USING (r)
"""
