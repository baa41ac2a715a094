"""BCF source: spans of variants from typed binary records, read by many tasks where an index tells places of records."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bgzf

SPANS = "contig string, start0 long, end0 long, name string"
# Fixed values of the format: the first bytes, and the sizes of its integer types.
MAGIC = b"BCF\x02"
INTS = {1: "<b", 2: "<h", 3: "<i"}
TEXT = 7
BATCH = 20_000
FIXED = struct.Struct("<IIiiifII")


def header(data: bytes) -> tuple[dict[int, str], int]:
    """Names of contigs by number, and the offset of the first record; IndexError if data ends before."""
    if data[:4] != MAGIC:
        raise ValueError("not a BCF file")
    (size,) = struct.unpack_from("<I", data, 5)
    if len(data) < 9 + size:
        raise IndexError("header goes on")
    names: dict[int, str] = {}
    for line in re.findall(r"##contig=<([^\n]*)>", data[9 : 9 + size].decode("utf-8", "replace")):
        number = re.search(r"(?:^|,)IDX=(\d+)", line)
        names[int(number[1]) if number else len(names)] = re.search(r"(?:^|,)ID=([^,]+)", line)[1]
    return names, 9 + size


def _size(data: bytes, at: int) -> tuple[int, int, int]:
    """(type, number of values, where they begin) of a typed value."""
    kind, n = data[at] & 15, data[at] >> 4
    at += 1
    if n == 15:
        of = INTS[data[at] & 15]
        n = struct.unpack_from(of, data, at + 1)[0]
        at += 1 + struct.calcsize(of)
    return kind, n, at


def span(data: bytes, at: int, names: dict[int, str]) -> tuple[str, int, int, str]:
    """(contig, start0, end0, name) of the record at an offset."""
    _, _, ref, start, size, _, _, _ = FIXED.unpack_from(data, at)
    kind, n, first = _size(data, at + FIXED.size)
    name = data[first : first + n].rstrip(b"\0").decode() if kind == TEXT else ""
    return names[ref], start, start + max(size, 0), name or "."


def records(path: str, begin: int, end: int | None, names: dict[int, str]) -> Iterator[tuple[str, int, int, str]]:
    """Spans of the records between two places; to the end of the file without an end."""
    file, size = bgzf.open_file(path)
    data, at, base, limit = b"", begin & 0xFFFF, 0, None
    for offset, block in bgzf.inflated(file, size, begin >> 16):
        if end is not None and offset >= end >> 16:
            limit = base + len(data) + (end & 0xFFFF if offset == end >> 16 else 0)
        data += block
        while at + 8 <= len(data) and (limit is None or base + at < limit):
            after = at + 8 + sum(struct.unpack_from("<II", data, at))
            if after > len(data):
                break
            yield span(data, at, names)
            at = after
        if limit is not None and base + at >= limit:
            return
        data, base, at = data[at:], base + at, 0
    if data and limit is None:
        raise ValueError(f"{path} ends inside a record")


def _first(path: str) -> tuple[dict[int, str], int]:
    """Contigs, and the place of the first record."""
    file, size = bgzf.open_file(path)
    data, places = b"", []
    for offset, block in bgzf.inflated(file, size, 0):
        places.append((len(data), offset))
        data += block
        try:
            names, at = header(data)
        except (struct.error, IndexError):
            continue
        first, offset = [p for p in places if p[0] <= at][-1]
        return names, offset << 16 | at - first
    raise ValueError(f"no whole BCF header: {path}")


def _of_ranges(spark: SparkSession, groups: list[tuple[str, list[tuple[int, int | None]], dict[int, str]]]) -> DataFrame:
    sent = spark.sparkContext.broadcast(groups)

    def work(batches):
        for batch in batches:
            for i in batch.column("id").to_pylist():
                path, ranges, names = sent.value[i]
                rows = []
                for begin, end in ranges:
                    for r in records(path, begin, end, names):
                        rows.append(r)
                        if len(rows) >= BATCH:
                            yield _batch(rows)
                            rows = []
                yield _batch(rows)

    return spark.range(0, len(groups), 1, max(1, len(groups))).mapInArrow(work, SPANS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["contig", "start0", "end0", "name"])


def _files(spark: SparkSession, path: str) -> list[str]:
    found = [f for f, _ in bgzf.files(spark, path)]
    found = [f for f in found if f.lower().endswith(".bcf")] or found
    if not bgzf.reachable(found[0]):
        raise ValueError(f"executors can't open {found[0]}; convert to VCF")
    return found


def bcf(spark: SparkSession, path: str, split_bytes: int = 32 << 20) -> DataFrame:
    """Spans of all records (contig, start0, end0, name). A file with a CSI is read by a task for about split_bytes, cut where chunks begin; without one by one task."""
    groups = []
    for file in _files(spark, path):
        names, first = _first(file)
        index = bgzf.index_beside(file)
        cuts = [first]
        for place in index.starts() if index else []:
            if (place >> 16) - (cuts[-1] >> 16) >= split_bytes:
                cuts.append(place)
        groups += [(file, [(a, b)], names) for a, b in zip(cuts, [*cuts[1:], None])]
    return _of_ranges(spark, groups)


def bcf_region(spark: SparkSession, path: str, contig: str, start0: int, end0: int, split_bytes: int = 32 << 20) -> DataFrame:
    """Spans of the records that overlap a region, by the CSI of each file; of files without one by a filtered scan."""
    groups = []
    for file in _files(spark, path):
        names, first = _first(file)
        index = bgzf.index_beside(file)
        number = next((i for i, n in names.items() if n == contig), None)
        if number is not None:
            groups += [(file, g, names) for g in bgzf.grouped(index.chunks(number, start0, end0), split_bytes)] if index else [(file, [(first, None)], names)]
    return _of_ranges(spark, groups).filter((F.col("contig") == contig) & (F.col("start0") < end0) & (F.col("end0") > start0))
