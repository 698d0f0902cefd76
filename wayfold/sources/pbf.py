"""Map extracts in the protobuf block format, as a Python data source.

``spark.read.format("mappbf").option("path", p).option("kind", "nodes").load()``
reads nodes, ways or relations.  The driver reads only blob headers (offset and
length of each block); every partition is a run of blocks that a task opens,
unpacks and decodes.  Blocks are ordered nodes, ways, relations, so the first
block of a kind is found by bisection and other kinds' blocks are never opened.
Files are opened through ``pyarrow.fs``, so any store that it knows serves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

KINDS = ("nodes", "ways", "relations")
TAGS = "tags array<struct<k:string,v:string>>"
SCHEMAS = {
    "nodes": f"id long, lat_e7 long, lon_e7 long, {TAGS}",
    "ways": f"id long, refs array<long>, {TAGS}",
    "relations": f"id long, members array<struct<pos:int,type:string,role:string,ref:long>>, {TAGS}",
    "blobs": "pos long, length long, kind string, entries long, min_id long, max_id long",
}
BLOCKS_A_PARTITION = 16


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


def packed(data: bytes, signed: bool = False) -> list[int]:
    out, at = [], 0
    while at < len(data):
        value, at = varint(data, at)
        out.append((value >> 1) ^ -(value & 1) if signed else value)
    return out


def running(deltas: list[int]) -> list[int]:
    out, now = [], 0
    for d in deltas:
        now += d
        out.append(now)
    return out


def _opened(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def blob_index(path: str) -> list[tuple[int, int]]:
    """(offset, length) of each data blob; payloads are skipped."""
    found = []
    with _opened(path) as f:
        at, size = 0, f.size()
        while at < size:
            head = int.from_bytes(f.read_at(4, at), "big")
            header = dict(fields(f.read_at(head, at + 4)))
            if header[1] == b"OSMData":
                found.append((at + 4 + head, int(header[3])))
            at += 4 + head + int(header[3])
    return found


def unpacked(data: bytes) -> bytes:
    blob = dict(fields(data))
    if 3 in blob:
        return zlib.decompress(blob[3])
    if 1 in blob:
        return blob[1]
    raise ValueError("blob is neither raw nor zlib")


def block(data: bytes) -> tuple[list[str], list[bytes]]:
    """(strings, groups) of a block; other granularities and offsets are refused."""
    strings, groups = [], []
    for number, value in fields(data):
        if number == 1:
            strings = [s.decode("utf-8", "replace") for n, s in fields(value) if n == 1]
        elif number == 2:
            groups.append(value)
        elif (number == 17 and value != 100) or (number in (19, 20) and value != 0):
            raise ValueError("granularity must be 100 and offsets 0")
    return strings, groups


def kind_of(data: bytes) -> int:
    """Place in KINDS of a block's entries."""
    for group in block(data)[1]:
        for number, _ in fields(group):
            return {1: 0, 2: 0, 3: 1, 4: 2}[number]
    return 0


def _tags(strings: list[str], keys: list[int], values: list[int]) -> list[tuple[str, str]]:
    return [(strings[k], strings[v]) for k, v in zip(keys, values, strict=True)]


def rows(data: bytes) -> Iterator[tuple]:
    """Rows of a block, as of its kind's schema."""
    strings, groups = block(data)
    for group in groups:
        for number, value in fields(group):
            if number == 2:
                dense = dict(fields(value))
                pairs = packed(dense.get(10, b""))
                each = _windows(pairs)
                ids, lats, lons = (running(packed(dense[n], True)) for n in (1, 8, 9))
                for i, lat, lon in zip(ids, lats, lons, strict=True):
                    kv = next(each, [])
                    yield i, lat, lon, _tags(strings, kv[::2], kv[1::2])
            elif number == 3:
                way = dict(fields(value))
                yield way[1], running(packed(way.get(8, b""), True)), _tags(strings, packed(way.get(2, b"")), packed(way.get(3, b"")))
            elif number == 4:
                rel = dict(fields(value))
                refs, roles, types = running(packed(rel.get(9, b""), True)), packed(rel.get(8, b"")), packed(rel.get(10, b""))
                members = [(n, ("node", "way", "relation")[t], strings[r], m) for n, (t, r, m) in enumerate(zip(types, roles, refs, strict=True))]
                yield rel[1], members, _tags(strings, packed(rel.get(2, b"")), packed(rel.get(3, b"")))


def _windows(pairs: list[int]) -> Iterator[list[int]]:
    """Key and value numbers of each dense node; a zero in a key's place ends one."""
    held: list[int] = []
    at = 0
    while at < len(pairs):
        if pairs[at] == 0:
            yield held
            held, at = [], at + 1
        else:
            held += pairs[at : at + 2]
            at += 2


class Blocks(InputPartition):
    def __init__(self, places: list[tuple[int, int]]):
        self.places = places


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options.get("kind", "nodes")

    def _kind_at(self, f, place: tuple[int, int]) -> int:
        return kind_of(unpacked(f.read_at(place[1], place[0])))

    def partitions(self):
        places = blob_index(self.path)
        if self.kind != "blobs":
            wanted = KINDS.index(self.kind)
            with _opened(self.path) as f:
                first, last = (self._bisect(f, places, k) for k in (wanted, wanted + 1))
            places = places[first:last]
        return [Blocks(places[n : n + BLOCKS_A_PARTITION]) for n in range(0, len(places), BLOCKS_A_PARTITION)] or [Blocks([])]

    def _bisect(self, f, places, kind: int) -> int:
        low, high = 0, len(places)
        while low < high:
            mid = (low + high) // 2
            if self._kind_at(f, places[mid]) < kind:
                low = mid + 1
            else:
                high = mid
        return low

    def read(self, partition: Blocks):
        if not partition.places:
            return
        with _opened(self.path) as f:
            for at, size in partition.places:
                data = unpacked(f.read_at(size, at))
                if self.kind != "blobs":
                    yield from rows(data)
                else:
                    ids = [r[0] for r in rows(data)]
                    yield at, size, KINDS[kind_of(data)], len(ids), min(ids, default=None), max(ids, default=None)


class MapPbf(DataSource):
    """The registered source; kind is nodes, ways, relations or blobs."""

    @classmethod
    def name(cls) -> str:
        return "mappbf"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "nodes")]

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def register(spark) -> None:
    spark.dataSource.register(MapPbf)
