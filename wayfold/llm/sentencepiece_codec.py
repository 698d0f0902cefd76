"""SentencePiece encoding that keeps the source bytes of every piece, and decoding.

Normalisation: the longest prefix of the rest of the text that the model's
compiled character map knows is replaced, else one character is copied; every
normalised byte records the source byte span it came from.  A piece covers a
run of normalised bytes, so its source span goes from the first span's start
to the last span's end.  A model with an empty map (only spaces change) is
aligned for a whole text at once in numpy.

Encoding: the parts of ``pieces.PieceModel`` are encoded by the library, each
distinct one once for each worker within a bounded memory; decoding is the
library's.

Cases: a null text is an empty one: no ids, an empty decoded text.  The space
mark that the model puts before a text has the empty span at 0.  Rows are
independent: repeated rows, null ids and other columns make no difference.
Batches are sliced by bytes.
"""

from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from wayfold.llm import pieces
from wayfold.llm.common import in_bytes, table

MARK = pieces.SPACE.encode()


class CharacterMap:
    """The model's compiled map: a double-array trie from byte strings to replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(source length, replacement) of the longest known prefix of data[at:]."""
        if not self.units:
            return None
        found, unit, node = None, self.units[0], 0
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        for end in range(at, len(data)):
            node ^= data[end]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[end]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                start = self.units[node] & 0x7FFFFFFF
                found = end + 1 - at, self.strings[start : self.strings.index(b"\0", start)]
        return found


def _character(data: bytes, at: int) -> int:
    lead = data[at]
    return 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


def normalise(text: str, spec, known: CharacterMap) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Normalised bytes, and the source start and end of each of them."""
    data = text.encode()
    if not data:
        return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not known.units and spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces:
        source = np.frombuffer(data, np.uint8)
        at = np.repeat(np.arange(len(source)), np.where(source == 32, 3, 1))
        front = np.zeros(3, np.int64)
        return MARK + data.replace(b" ", MARK), np.concatenate([front, at]), np.concatenate([front, at + 1])
    space = MARK if spec.escape_whitespaces else b" "
    units: list[tuple[bytes, int, int]] = []
    at = 0
    while at < len(data):
        size, new = known.longest(data, at) or (n := _character(data, at), data[at : at + n])
        units.append((new, at, at + size))
        at += size
    if spec.remove_extra_whitespaces:
        while units and units[0][0] == b" ":
            units.pop(0)
        while units and units[-1][0] == b" ":
            units.pop()
    out, starts, ends = bytearray(), [], []

    def put(piece: bytes, start: int, end: int) -> None:
        out.extend(piece)
        starts.extend([start] * len(piece))
        ends.extend([end] * len(piece))

    if units and spec.add_dummy_prefix:
        put(space, units[0][1], units[0][1])
    before = bool(spec.remove_extra_whitespaces)
    for new, start, end in units:
        while before and new.startswith(b" "):
            new = new[1:]
        if not new:
            continue
        put(new.replace(b" ", space), start, end)
        before = bool(spec.remove_extra_whitespaces) and new.endswith(b" ")
    while spec.remove_extra_whitespaces and bytes(out).endswith(space) and len(out) > len(space):
        del out[-len(space) :], starts[-len(space) :], ends[-len(space) :]
    return bytes(out), np.array(starts, np.int64), np.array(ends, np.int64)


class Codec:
    """Encodes texts to ids with source byte spans, and decodes ids."""

    def __init__(self, path: str):
        self.model = pieces.load(path)
        self.map = CharacterMap(self.model.spec.precompiled_charsmap)
        self.lengths = np.array([1 if t == 6 else len(s.encode()) for s, t in zip(self.model.strings, self.model.types, strict=True)], np.int64)
        self.known = pieces.Remembered(lambda parts: [(np.array(ids, np.int32).tobytes(), ",".join(map(str, ids))) for ids in self.model.encode_parts(parts)])

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """The ids of ``text``, as an array and as decimals joined by commas."""
        if not self.model.splits:
            ids = self.model.processor.encode(text)
            return np.array(ids, np.int32), ",".join(map(str, ids))
        found = self.known.of(self.model.parts(text))
        return np.frombuffer(b"".join([f[0] for f in found]), np.int32), ",".join([f[1] for f in found])

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Source byte start and end of each id's piece."""
        if not len(ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        normal, starts, ends = normalise(text, self.model.spec, self.map)
        last = np.cumsum(self.lengths[ids])
        if last[-1] != len(normal):  # an unknown piece stands for any text: the library knows how much
            return self._library_spans(text)
        return starts[np.concatenate([[0], last[:-1]])], ends[last - 1]

    def _library_spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        proto = self.model.processor.encode_as_proto(text)
        return np.array([p.begin for p in proto.pieces], np.int64), np.array([p.end for p in proto.pieces], np.int64)

    def decode(self, ids: np.ndarray) -> str:
        return self.model.processor.decode(ids.tolist())


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(documents: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", ids_out: bool = True, spans_out: bool = False) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256, spans_sha256 for each row; no shuffle.

    With ``ids_out`` also ids, with ``spans_out`` starts and ends (arrays:
    source byte spans) and the decoded text.  spans_sha256 is of the starts and then the ends as
    little-endian 64-bit integers.
    """
    wanted = ["ids"] * ids_out + ["starts", "ends", "decoded"] * spans_out
    types = {"ids": pa.list_(pa.int32()), "starts": pa.list_(pa.int64()), "ends": pa.list_(pa.int64()), "decoded": pa.string()}
    digests = ["ids_sha256", "decoded_sha256", "spans_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        names = ["n_tokens", *digests, *wanted]
        for whole in batches:
            for batch in in_bytes(whole, "text", 2 << 20):
                rows: dict[str, list] = {n: [] for n in names}
                for t in batch.column(1).to_pylist():
                    t = t or ""
                    ids, decimals = own.encode(t)
                    starts, ends = own.spans(t, ids)
                    decoded = own.decode(ids)
                    spans = hashlib.sha256(starts.astype("<i8").tobytes())
                    spans.update(ends.astype("<i8").tobytes())
                    found = {"n_tokens": len(ids), "ids_sha256": hashlib.sha256(decimals.encode()).hexdigest(), "decoded_sha256": hashlib.sha256(decoded.encode()).hexdigest(), "spans_sha256": spans.hexdigest(), "ids": ids, "starts": starts, "ends": ends, "decoded": decoded}
                    for n in names:
                        rows[n].append(found[n])
                columns = [pa.array(rows[n], types.get(n, pa.string() if n in digests else pa.int64())) for n in names]
                yield pa.record_batch([batch.column(0), *columns], names=["key", *names])

    source = documents.select(documents[key].alias("key"), documents[text].alias("text"))
    kinds = {"ids": "array<int>", "starts": "array<long>", "ends": "array<long>", "decoded": "string"}
    schema = [f"key {source.schema['key'].dataType.simpleString()}", "n_tokens long", *(f"{n} string" for n in digests), *(f"{n} {kinds[n]}" for n in wanted)]
    return source.mapInArrow(run, ", ".join(schema)).withColumnRenamed("key", key)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ids_out=False)
