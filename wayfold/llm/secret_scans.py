"""Secret scans: fixed patterns, and random strings found by a tokenizer.

Fixed kinds: ``assign`` (a secret's name, a sign and a value of 6 characters or
more), ``access`` (AKIA keys of 20 or more), ``hex`` (runs of 24 or more).
The method's kind, ``random``: strings of 20 or more characters of the base64
alphabets are cut into tokens of a public byte-level vocabulary.  Written
language needs few tokens for its characters, random strings many, so a string
with under ``CHARS_PER_TOKEN`` characters for each token is random.  Left out:
digests of well-known lengths, UUIDs, numbers, and identifiers (strings that
are mostly words).  A run of letters in lower case, camel case or capitals is a
word if the vocabulary cuts it in ``WORD_CHARS`` characters a token or more.

Parts between separators are told apart: readable ones (numbers, identifiers)
at a string's ends are not judged with the rest, and where the rest is not
random as a whole, its groups of parts with little readable text between them
are judged, and then its long parts by themselves.

Spans are code points, end exclusive; an ``assign`` span covers the whole
match, from the name to the value's end, a ``random`` span the random parts
and ends that are too short to tell.

Cases: a null text is an empty one.  Rows are independent: repeated rows, null
ids and other columns make no difference.  Batches are sliced by bytes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from wayfold.llm.common import in_bytes, table

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: The same matches as of [0-9a-f]+ with the short ones dropped.
HEX = re.compile(r"[0-9a-f]{24,}")
LONG = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Hexadecimal lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGESTS = (32, 40, 56, 64, 96, 128)
HEXADECIMAL = re.compile(r"[0-9a-fA-F]+")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: A UUID is one part.
PART = re.compile(rf"(?<![A-Za-z0-9]){UUID.pattern}(?![A-Za-z0-9])|[A-Za-z0-9]+")
#: Runs of letters that may be words: lower case or capitalised, or capitals.
LETTERS = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{3,}(?![a-z])|[A-Z]{3,}(?=[A-Z][a-z])")
WORD_CHARS = 3.0
LEAST = 20
#: Letters and digits outside words that a random string has.
UNREADABLE = 16
#: Characters between parts of one group.
NEAR = 8
NUMBER = re.compile(r"[0-9+/_=-]+")
#: Share of its characters that words make up in an identifier.
WORDY = 0.6
CHARS_PER_TOKEN = 2.2
REDACTED = "[REDACTED]"


@functools.lru_cache(maxsize=2)
def vocabulary(path: str):
    """The byte-level vocabulary of a ``.tiktoken`` file."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:  # a file of the tokenizer package on this machine, not an input
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("secret-scans", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _is_word(run: str, encoding) -> bool:
    """Whether the vocabulary knows a run of letters, within a text or after a blank."""
    low = run.lower()
    return len(low) >= WORD_CHARS * min(len(encoding.encode_ordinary(low)), len(encoding.encode_ordinary(" " + low)))


def _is_exempt(value: str) -> bool:
    return bool(NUMBER.fullmatch(value) or UUID.fullmatch(value) or HEXADECIMAL.fullmatch(value) and len(value) in DIGESTS)


def _in_words(value: str, encoding) -> int:
    return sum(len(run) for run in LETTERS.findall(value) if _is_word(run, encoding))


def is_identifier(value: str, encoding) -> bool:
    return bool(NUMBER.fullmatch(value)) or _in_words(value, encoding) >= WORDY * sum(map(str.isalnum, value))


def _is_random_part(value: str, encoding) -> bool:
    if len(value) < LEAST or _is_exempt(value) or len(value) >= CHARS_PER_TOKEN * len(encoding.encode_ordinary(value)):
        return False
    signs, words = sum(map(str.isalnum, value)), _in_words(value, encoding)
    return words < WORDY * signs and signs - words >= UNREADABLE


def random_spans(value: str, encoding) -> list[tuple[int, int]]:
    """(start, end) of the random parts of a string of the base64 alphabets."""
    parts = [m.span() for m in PART.finditer(value)]
    odd = [at for at, (a, b) in enumerate(parts) if not _is_exempt(value[a:b]) and not is_identifier(value[a:b], encoding)]
    if not odd:
        return []
    first, last = odd[0], odd[-1]
    # ends of under 4 characters can't be told from a piece of the random part
    start = parts[first][0] if parts[first][0] - parts[0][0] >= 4 else 0
    end = parts[last][1] if parts[-1][1] - parts[last][1] >= 4 else len(value)
    if _is_random_part(value[start:end], encoding):
        return [(start, end)]
    groups = [[parts[odd[0]]]]
    for at in odd[1:]:
        if parts[at][0] - groups[-1][-1][1] < NEAR:
            groups[-1].append(parts[at])
        else:
            groups.append([parts[at]])
    found = []
    for group in groups:
        whole = group[0][0], group[-1][1]
        found += [(a, b) for a, b in ([whole] if _is_random_part(value[whole[0] : whole[1]], encoding) else group) if _is_random_part(value[a:b], encoding)]
    return found


def is_random(value: str, encoding) -> bool:
    return bool(random_spans(value, encoding))


def scan(text: str, encoding) -> list[tuple[int, int, int]]:
    """(start, place in KINDS, end) of every span, in order; the first three kinds are the fixed ones."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found += [(m.start() + a, 3, m.start() + b) for m in LONG.finditer(text) for a, b in random_spans(m[0], encoding)]
    return sorted(found)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with every span, or run of overlapping ones, replaced by one mark."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], REDACTED]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_documents(documents: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_assign, n_access, n_hex, n_random, base_sha256, spans for each row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary(path)
        for whole in batches:
            for batch in in_bytes(whole, "text"):
                found = [scan(t or "", encoding) for t in batch.column(1).to_pylist()]
                counts = [pa.array([sum(k == kind for _, k, _ in f) for f in found], pa.int64()) for kind in range(len(KINDS))]
                digests = [hashlib.sha256(_written([s for s in f if s[1] < 3]).encode()).hexdigest() for f in found]
                yield pa.record_batch(
                    [batch.column(0), *counts, pa.array(digests, pa.string()), pa.array(map(_written, found), pa.string())],
                    names=["key", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"],
                )

    source = documents.select(documents[key].alias("key"), documents[text].alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string").withColumnRenamed("key", key)


def redact_documents(documents: DataFrame, path: str, *, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """All columns of ``documents`` with secrets replaced in ``text``.

    ``length``, if that column exists, gets the new number of characters of
    changed texts.  Null texts stay null.
    """
    at = documents.columns.index(text)
    sized = documents.columns.index(length) if length in documents.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary(path)
        for whole in batches:
            for batch in in_bytes(whole, text):
                texts = batch.column(at).to_pylist()
                new = [t if t is None or not (spans := scan(t, encoding)) else redact(t, spans) for t in texts]
                columns = list(batch.columns)
                columns[at] = pa.array(new, batch.schema.field(at).type)
                if sized is not None:
                    old = batch.column(sized).to_pylist()
                    columns[sized] = pa.array([o if a is b else len(b) for o, a, b in zip(old, texts, new, strict=True)], batch.schema.field(sized).type)
                yield pa.record_batch(columns, schema=batch.schema)

    return documents.mapInArrow(run, documents.schema)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return scan_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
