"""Token counts by a whole-token shortcut.

Offline proof: every vocabulary string is encoded alone; those that come back
as their own single token are *whole*.  A text is cut into parts that encode
independently (pre-tokens), parts that are whole tokens count one each by a
table lookup, and only the rest is merged, each distinct one once for each
worker (a bounded memory).  A ``.model`` file is read by ``sentencepiece``, a
``.json`` file by ``tokenizers``, which counts whole texts: the shortcut is not
built there.  Models whose cuts can't be proved exact are counted likewise.

Cases: a null text counts as empty (0 tokens).  Rows are independent: repeated
rows, null ids and other columns make no difference.  Texts are never cut
short; batches are sliced by bytes, so long texts bound a worker's memory.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from wayfold.llm import pieces
from wayfold.llm.common import in_bytes, table

CONTEXT = 4096


def _model_counter(path: str) -> Callable[[str], int]:
    model = pieces.load(path)
    if not model.splits:
        return lambda text: len(model.processor.encode(text))
    counts = pieces.Remembered(lambda parts: list(map(len, model.encode_parts(parts))), dict.fromkeys(model.whole_tokens(), 1))
    return lambda text: sum(counts.of(model.parts(text)))


def _json_counter(path: str) -> Callable[[str], int]:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Callable[[str], int]:
    """A function from a text to its number of tokens."""
    return _json_counter(path) if path.endswith(".json") else _model_counter(path)


def count_tokens(documents: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", limit: int = CONTEXT) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit for each row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for whole in batches:
            for batch in in_bytes(whole, "text"):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                tokens = [count(t) for t in texts]
                yield pa.record_batch(
                    [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                    names=["key", "n_bytes", "n_tokens", "over_limit"],
                )

    source = documents.select(documents[key].alias("key"), documents[text].alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key", key)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
