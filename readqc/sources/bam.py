"""BAM source: scans and region reads by many tasks, which decode only the columns that are asked for.

``readqc_bam`` is a data source of Spark. Its partitions are byte ranges of files. A task finds the first record of its
range by looking for a place from which several records follow one another, goes on over the range's end to the first
record of the next one, and makes sure that the same search finds that record there; so ranges neither lose nor share
records. Records are decoded column by column in numpy; names, operations, bases, qualities and tags that the schema doesn't
name are stepped over, and filters on the fixed fields are applied before anything else is decoded. With an index, a
filter on the contig leaves the partitions of its chunks. Regions are read the same way, a task some chunks.

Executors open files by pyarrow. A store that only Spark reads is scanned by blocks, as lines of Spark's text reader:
there, records over the borders of splits are put together by file.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import datasource as D

from ..functions.expressions import alignment_end
from ..operators.intervals import range_join
from ..store import stored
from . import bgzf
from .text import contigs_of

# Fixed values of the format: base codes, CIGAR codes, sizes of tag types.
BASES = "=ACMGRSVTWYHKDBN"
OPS = "MIDNSHP=X"
SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
INTS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}
SCHEMA = "qname string, flags int, ref_id int, contig string, pos0 long, mapq int, mate_ref_id int, mate_pos0 long, tlen int, cigar array<struct<op:string,len:int>>, seq string, quals string, nm long, mq long, has_sa boolean"
_NAMES = [f.split(" ")[0] for f in SCHEMA.replace("array<struct<op:string,len:int>>", "ops").split(", ")]
FIXED = struct.Struct("<iiiBBHHHiiii")
FIELDS = np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("n_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_ops", "<u2"), ("flags", "<u2"), ("n_seq", "<i4"), ("mate", "<i4"), ("mate_pos", "<i4"), ("tlen", "<i4")])
_PAIRS = np.array([[ord(BASES[b >> 4]), ord(BASES[b & 15])] for b in range(256)], np.uint8)  # the two bases of a byte
_ON_REFERENCE = np.array([o in "MDN=X" for o in OPS])
BATCH, CHAIN, CHUNK = 5000, 4, 4 << 20
READS = "read_id long, " + SCHEMA


def header(data: bytes) -> tuple[list[str], list[str], int]:
    """Header lines, contig names and the offset of the first record; struct.error or IndexError if data ends before."""
    if data[:4] != b"BAM\x01":
        raise ValueError("not a BAM file")
    n = struct.unpack_from("<i", data, 4)[0]
    lines = data[8 : 8 + n].rstrip(b"\0").decode().splitlines()
    at = 8 + n
    (count,) = struct.unpack_from("<i", data, at)
    at += 4
    names, sq = [], []
    for _ in range(count):
        (size,) = struct.unpack_from("<i", data, at)
        length = struct.unpack_from("<i", data, at + 4 + size)[0]
        names.append(data[at + 4 : at + 3 + size].decode())
        sq.append(f"@SQ\tSN:{names[-1]}\tLN:{length}")
        at += 8 + size
    return [*sq, *(x for x in lines if not x.startswith("@SQ"))], names, at


def read_header(spark: SparkSession, path: str) -> tuple[list[str], list[str], int]:
    """The header of the first file of a path, from no more of its first blocks than it takes."""
    found = bgzf.files(spark, path)
    name, size = next((f for f in found if f[0].endswith(".bam")), found[0])
    part = 1 << 18
    while True:
        try:
            return header(bgzf.inflate(bgzf.read_range(spark, name, 0, part)))
        except (struct.error, IndexError):
            if part >= size:
                raise ValueError(f"no whole BAM header: {name}") from None
            part *= 4


def tags(data: bytes, at: int, end: int) -> tuple[int | None, int | None, bool]:
    """NM, MQ and whether SA is there; other tags are stepped over."""
    nm = mq = None
    sa = False
    while at < end:
        name, kind = data[at : at + 2], chr(data[at + 2])
        at += 3
        if name == b"SA":
            sa = True
        if kind in INTS and name in (b"NM", b"MQ"):
            value = struct.unpack_from(INTS[kind], data, at)[0]
            nm, mq = (value, mq) if name == b"NM" else (nm, value)
        if kind in SIZES:
            at += SIZES[kind]
        elif kind in "ZH":
            at = data.index(b"\0", at) + 1
        elif kind == "B":
            at += 5 + SIZES[chr(data[at])] * struct.unpack_from("<i", data, at + 1)[0]
        else:
            raise ValueError(f"unknown tag type {kind}")
    return nm, mq, sa


def _plausible(data: bytes, at: int, refs: int) -> int | None:
    """The length of what may be a record at this place; None if it can't be one."""
    if at + 36 > len(data):
        return None
    size, ref, pos, n_name, _, _, n_ops, flags, n_seq, mate, mate_pos, _ = FIXED.unpack_from(data, at)
    if not (-1 <= ref < refs and -1 <= mate < refs and pos >= -1 and mate_pos >= -1 and n_name > 0 and n_seq >= 0 and flags < 1 << 12):
        return None
    if size < 32 + n_name + 4 * n_ops + (n_seq + 1) // 2 + n_seq or size > 1 << 28:
        return None
    name = data[at + 36 : at + 36 + n_name]
    if len(name) == n_name and (name[-1] or not all(33 <= b <= 126 for b in name[:-1])):
        return None
    ops = data[at + 36 + n_name : at + 36 + n_name + 4 * n_ops : 4]
    return 4 + size if all(b & 15 < len(OPS) for b in ops) else None


def first_record(data: bytes, refs: int, last: bool = False) -> int | None:
    """The first place from which CHAIN records follow one another, or at least two whole ones up to the end of data; at a file's end (last) one is enough if it ends there."""
    for at in range(max(0, len(data) - 35)):
        here, whole = at, 0
        while whole < CHAIN:
            size = _plausible(data, here, refs)
            if size is None or here + size > len(data):
                break
            here, whole = here + size, whole + 1
        if whole == CHAIN or (whole and here == len(data) if last else whole >= 2 and (size is not None or here + 36 > len(data))):
            return at
    return None


def offsets(data: bytes, at: int) -> tuple[np.ndarray, int]:
    """Where the whole records from this place on begin, and where the next one does."""
    found = []
    while at + 4 <= len(data):
        end = at + 4 + struct.unpack_from("<i", data, at)[0]
        if end > len(data):
            break
        found.append(at)
        at = end
    return np.array(found, np.int64), at


def _gather(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """raw[start : start + size] of each record, one after the other."""
    end = np.cumsum(size)
    return raw[np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)]


def _texts(chars: np.ndarray, size: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(chars))])


class Records:
    """Records of a buffer, decoded a column at a time and only on demand."""

    def __init__(self, data: bytes, at: np.ndarray, names: list[str]):
        self.data, self.names = data, names
        self.raw = np.frombuffer(data, np.uint8)
        self.at = at
        self.fixed = np.ascontiguousarray(self.raw[at[:, None] + np.arange(36)]).view(FIELDS).reshape(len(at))

    def where(self, keep: np.ndarray) -> Records:
        out = object.__new__(Records)
        out.data, out.names, out.raw, out.at, out.fixed = self.data, self.names, self.raw, self.at[keep], self.fixed[keep]
        return out

    def _field(self, name: str) -> np.ndarray:
        return self.fixed[name].astype(np.int64)

    def _ops_at(self) -> np.ndarray:
        return self.at + 36 + self._field("n_name")

    def _seq_at(self) -> np.ndarray:
        return self._ops_at() + 4 * self._field("n_ops")

    def operations(self) -> tuple[np.ndarray, np.ndarray]:
        """All CIGAR operations, and where those of each record end."""
        raw = _gather(self.raw, self._ops_at(), 4 * self._field("n_ops")).view("<u4")
        if len(raw) and int((raw & 15).max()) >= len(OPS):
            raise ValueError(f"invalid CIGAR code {int((raw & 15).max())}")
        return raw, np.concatenate([[0], np.cumsum(self._field("n_ops"))])

    def ends(self) -> np.ndarray:
        """Exclusive end on the reference; -1 if unmapped or without span."""
        raw, ends = self.operations()
        along = np.concatenate([[0], np.cumsum(np.where(_ON_REFERENCE[raw & 15], raw >> 4, 0).astype(np.int64))])
        span = along[ends[1:]] - along[ends[:-1]]
        return np.where((self.fixed["flags"] & 4 == 0) & (span > 0), self._field("pos") + span, -1)

    def number(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """(values, which are missing) of a column that lies in the fixed fields."""
        field = {"flags": "flags", "ref_id": "ref", "contig": "ref", "pos0": "pos", "mapq": "mapq", "mate_ref_id": "mate", "mate_pos0": "mate_pos", "tlen": "tlen"}[name]
        values = self._field(field)
        return values, (values == 255 if name == "mapq" else values < 0 if name != "tlen" else np.zeros(len(values), bool))

    def column(self, name: str) -> pa.Array:
        if name in ("flags", "ref_id", "mapq", "mate_ref_id", "tlen", "pos0", "mate_pos0"):
            values, missing = self.number(name)
            return pa.array(values, pa.int64() if name.endswith("pos0") else pa.int32(), mask=missing)
        if name == "contig":
            values, missing = self.number(name)
            return pa.array(self.names, pa.string()).take(pa.array(values, pa.int64(), mask=missing))
        if name == "qname":
            size = self._field("n_name") - 1
            made = _texts(_gather(self.raw, self.at + 36, size), size)
            return pc.if_else(pc.equal(made, "*"), None, made)
        if name == "cigar":
            raw, ends = self.operations()
            op = pa.DictionaryArray.from_arrays(pa.array((raw & 15).astype(np.int32)), pa.array(list(OPS))).cast(pa.string())
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([op, pa.array((raw >> 4).astype(np.int32))], names=["op", "len"]))
        n = self._field("n_seq")
        half = (n + 1) // 2
        if name == "seq":
            chars = _PAIRS[_gather(self.raw, self._seq_at(), half)].ravel()
            return _texts(_gather(chars, np.cumsum(2 * half) - 2 * half, n), n)
        start = self._seq_at() + half
        if name == "quals":
            size = np.where(self.raw[np.minimum(start, len(self.raw) - 1)] == 255, 0, n)
            return _texts(np.minimum(_gather(self.raw, start, size), 93) + np.uint8(33), size)
        return self._tags()[name]

    def _tags(self) -> dict[str, pa.Array]:
        if not hasattr(self, "_read"):
            start, end = self._seq_at() + (self._field("n_seq") + 1) // 2 + self._field("n_seq"), self.at + 4 + self._field("size")
            found = [tags(self.data, a, b) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            self._read = {name: pa.array([f[i] for f in found], kind) for i, (name, kind) in enumerate((("nm", pa.int64()), ("mq", pa.int64()), ("has_sa", pa.bool_())))}
        return self._read

    def columns(self, want: list[str]) -> dict[str, pa.Array]:
        return {c: self.column(c) for c in want}


class Rows:
    """Decoded records of a scan by blocks."""

    def __init__(self, names: list[str]):
        self.names, self.parts, self.n = names, [], 0

    def __len__(self) -> int:
        return self.n

    def decode(self, data: bytes, at: int) -> int:
        """Adds the whole records from this place on; returns where the next one begins."""
        found, end = offsets(data, at)
        if len(found):
            self.parts.append(Records(data, found, self.names).columns(_NAMES))
            self.n += len(found)
        return end

    def batch(self) -> dict[str, pa.Array]:
        parts, self.parts, self.n = self.parts or [Records(b"", np.zeros(0, np.int64), self.names).columns(_NAMES)], [], 0
        return {c: pa.concat_arrays([p[c] for p in parts]) for c in _NAMES}


def _scan(names: list[str]):
    """Records, and as rows of their own the pieces (file, split, whether records were found, bytes before, bytes after)."""

    def work(batches):
        rows, pieces = Rows(names), []
        now, data, at, synced, inflater = None, b"", 0, False, bgzf.Inflater()

        def piece():
            if now is not None:
                pieces.append((*now, synced, head, data[at:] if synced else b""))

        def out():
            n, left = len(rows), list(pieces)
            pieces.clear()
            held = rows.batch()
            extra = [[None] * n + [p[i] for p in left] for i in range(5)]
            kinds = [pa.string(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
            arrays = [pa.concat_arrays([a, pa.nulls(len(left), a.type)]) for a in held.values()]
            return pa.RecordBatch.from_arrays([*arrays, *(pa.array(x, k) for x, k in zip(extra, kinds, strict=True))], names=[*_NAMES, "file", "split", "found", "head", "tail"])

        head = b""
        for batch in batches:
            for file, split, b in zip(*(batch.column(c).to_pylist() for c in ("file", "split", "b")), strict=True):
                if (file, split) != now:
                    if now is not None and not synced:
                        head, synced, at = _begin(data, now[1], len(names))
                        if synced:
                            at = rows.decode(data, at)
                    piece()
                    now, data, at, synced, head, inflater = (file, split), b"", 0, False, b"", bgzf.Inflater()
                    if split == 0:
                        continue
                data += inflater(b)
                if not synced and len(data) >= 1 << 20:
                    head, synced, at = _begin(data, split, len(names))
                if synced and len(data) - at >= 1 << 20:
                    at = rows.decode(data, at)
                    data, at = data[at:], 0
                if len(rows) >= BATCH:
                    yield out()
        if now is not None and not synced:
            head, synced, at = _begin(data, now[1], len(names))
        if synced:
            at = rows.decode(data, at)
        piece()
        yield out()

    return work


def _begin(data: bytes, split: int, refs: int) -> tuple[bytes, bool, int]:
    """(bytes before the first record, whether there is one, where it begins); of a file's first split the header is no such bytes."""
    if split == 0:
        try:
            return b"", True, header(data)[2]
        except (struct.error, IndexError):
            return data, False, 0
    at = first_record(data, refs)
    return (data, False, 0) if at is None else (data[:at], True, at)


def _joined(names: list[str]):
    """The records that lie over the borders of the splits of one file."""

    def work(pieces: pd.DataFrame) -> pd.DataFrame:
        rows, carry, first = Rows(names), b"", True
        for p in pieces.sort_values("split").itertuples():
            carry += p.head
            if not p.found:
                continue
            if not (first and not carry):
                at = header(carry)[2] if first else 0
                if rows.decode(carry, at) != len(carry):
                    raise ValueError(f"broken records before split {p.split} of {p.file}")
            carry, first = p.tail, False
        if carry and not (first and header(carry)[2] == len(carry)):
            at = header(carry)[2] if first else 0
            if rows.decode(carry, at) != len(carry):
                raise ValueError(f"{pieces['file'].iloc[0]} ends inside a record")
        return pa.table(rows.batch()).to_pandas()

    return work


def by_blocks(spark: SparkSession, path: str) -> DataFrame:
    """All reads by way of Spark's text reader, from any store; stored as Parquet, once for all that read them."""
    _, names, _ = read_header(spark, path)
    found = stored(bgzf.blocks(spark, path).mapInArrow(_scan(names), f"{SCHEMA}, file string, split long, found boolean, head binary, tail binary"), "bam")
    pieces = found.filter("file IS NOT NULL").select("file", "split", "found", "head", "tail")
    between = pieces.groupBy("file").applyInPandas(_joined(names), SCHEMA)
    rows = found.filter("file IS NULL").select(*_NAMES).union(between)
    return rows.select(F.monotonically_increasing_id().alias("read_id"), "*")


class Stretch:
    """A file's records between two places: whole blocks are inflated one after the other, records decoded some megabytes at a time."""

    def __init__(self, path: str, names: list[str]):
        self.file, self.size = bgzf.open_file(path)
        self.path, self.names = path, names

    def _blocks(self, begin: int) -> Iterator[tuple[int, bytes]]:
        return bgzf.inflated(self.file, self.size, begin)

    def header_end(self) -> int:
        """The place of the first record."""
        data, places = b"", []
        for at, block in self._blocks(0):
            places.append((len(data), at))
            data += block
            try:
                end = header(data)[2]
            except (struct.error, IndexError):
                continue
            if end < len(data):
                first, at = [p for p in places if p[0] <= end][-1]
                return at << 16 | end - first
        return self.size << 16

    def first_from(self, begin: int) -> int | None:
        """The place of the first record that starts in a block at or after a file offset; None if there is none."""
        at = bgzf.next_block(self.file, self.size, begin)
        if at is None:
            return None
        data, places, goal = b"", [], 1 << 18
        for at, block in self._blocks(at):
            places.append((len(data), at))
            data += block
            if len(data) >= goal:
                goal *= 4
                if (found := first_record(data, len(self.names))) is not None:
                    break
        else:
            found = first_record(data, len(self.names), last=True)
        if found is None:
            return None
        first, at = [p for p in places if p[0] <= found][-1]
        return at << 16 | found - first

    def records(self, begin: int, end: int) -> Iterator[tuple[Records, np.ndarray]]:
        """Records that start at places from begin on and before end, with their places; self.stopped becomes the place of the one after them, None at the file's end."""
        data, firsts, offs, at = b"", [], [], begin & 0xFFFF
        self.stopped = None
        blocks = self._blocks(begin >> 16)
        more = True
        while more:
            more = False
            for coffset, block in blocks:
                firsts.append(len(data))
                offs.append(coffset)
                data += block
                if len(data) - at >= CHUNK or coffset << 16 >= end:
                    more = True
                    break
            found, after = offsets(data, at)
            if len(found):
                block = np.searchsorted(firsts, found, "right") - 1
                places = (np.array(offs, np.int64)[block] << 16) | (found - np.array(firsts, np.int64)[block])
                inside = int(np.searchsorted(places, end))
                if inside:
                    yield Records(data, found[:inside], self.names), places[:inside]
                if inside < len(found):
                    self.stopped = int(places[inside])
                    return
            if more:  # keep what belongs to the next record
                last = int(np.searchsorted(firsts, after, "right")) - 1
                data, firsts, offs = data[after:], [f - after for f in firsts[last:]], offs[last:]
                at = 0
                if offs and not data:
                    firsts, offs = [], []
            elif after != len(data):
                raise ValueError(f"{self.path} ends inside a record")


#: Filters that the source applies by itself, to columns in the fixed fields.
_TESTS = {D.EqualTo: np.equal, D.GreaterThan: np.greater, D.GreaterThanOrEqual: np.greater_equal, D.LessThan: np.less, D.LessThanOrEqual: np.less_equal}
_FIXED = ("flags", "ref_id", "pos0", "mapq", "mate_ref_id", "mate_pos0", "tlen")


def _kept(records: Records, filters: list[tuple]) -> np.ndarray:
    keep = np.ones(len(records.at), bool)
    for kind, column, value in filters:
        values, missing = records.number(column)
        keep &= np.isin(values, value) & ~missing if kind == "in" else missing if kind == "null" else ~missing if kind == "filled" else kind(values, value) & ~missing
    return keep


def place_bits(files: list[tuple[str, int]]) -> int:
    """Bits that a place takes in the largest of these files; a file's number stands above them in read_id."""
    bits = 16 + max(size for _, size in files).bit_length()
    if bits + len(files).bit_length() > 63:
        raise ValueError("too many or too large files for numbers of reads")
    return bits


class BamReader(D.DataSourceReader):
    """Partitions (file number, file, begin, end): byte ranges, or places of an index's chunks if exact."""

    def __init__(self, schema, options: dict):
        self.want = [f.name for f in schema.fields]
        if unknown := set(self.want) - {"read_id", *_NAMES}:
            raise ValueError(f"no such column of reads: {', '.join(sorted(unknown))}")
        self.files = json.loads(options["files"]) if "files" in options else bgzf.listed(options["path"])
        self.bytes, self.filters, self.contigs = int(options.get("splitbytes", 64 << 20)), [], None
        head = bgzf.open_file(self.files[0][0])[0]
        part = 1 << 18
        while True:
            try:
                self.names = header(bgzf.inflate(head.read_at(min(part, self.files[0][1]), 0)))[1]
                break
            except (struct.error, IndexError):
                if part >= self.files[0][1]:
                    raise ValueError(f"no whole BAM header: {self.files[0][0]}") from None
                part *= 4
        self.shift = place_bits(self.files)

    def pushFilters(self, filters):  # noqa: N802 - the name is Spark's
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in _FIXED and type(f) in _TESTS:
                self.filters.append((_TESTS[type(f)], column, f.value))
            elif column in _FIXED and isinstance(f, D.In):
                self.filters.append(("in", column, [v for v in f.value if v is not None]))
            elif column in (*_FIXED, "contig") and isinstance(f, (D.IsNull, D.IsNotNull)):
                self.filters.append(("null" if isinstance(f, D.IsNull) else "filled", column, None))
            elif column == "contig" and isinstance(f, (D.EqualTo, D.In)):
                known = {n: i for i, n in enumerate(self.names)}
                ids = [known[v] for v in (f.value if isinstance(f, D.In) else [f.value]) if v in known]
                self.contigs = ids if self.contigs is None else [i for i in ids if i in self.contigs]
                self.filters.append(("in", "contig", ids))
            else:
                yield f

    def partitions(self):
        out = []
        top = min([v + (kind is np.less_equal) for kind, column, v in self.filters if column == "pos0" and kind in (np.less, np.less_equal)], default=1 << 60)
        for number, (path, size) in enumerate(self.files):
            index = bgzf.index_beside(path) if self.contigs is not None else None
            if index is not None:
                ranges = bgzf.merged_ranges([c for i in self.contigs for c in index.chunks(i, 0, top)])
                out += [D.InputPartition((number, path, group, True)) for group in bgzf.grouped(ranges, self.bytes)]
            else:
                out += [D.InputPartition((number, path, [(a, min(a + self.bytes, size))], False)) for a in range(0, size, self.bytes)]
        return out

    def read(self, partition):
        number, path, ranges, exact = partition.value
        stretch = Stretch(path, self.names)
        for begin, end in ranges:
            if not exact:
                first = stretch.header_end() if begin == 0 else stretch.first_from(begin)
                if first is None or first >= end << 16:
                    continue
                begin, end = first, end << 16
            for records, places in stretch.records(begin, end):
                keep = _kept(records, self.filters)
                if not keep.all():
                    records, places = records.where(keep), places[keep]
                columns = records.columns([c for c in self.want if c != "read_id"])
                columns["read_id"] = pa.array(number << self.shift | places)
                yield pa.RecordBatch.from_arrays([columns[c] for c in self.want], names=self.want)
            if not exact and end >> 16 < stretch.size and stretch.first_from(end >> 16) != stretch.stopped:
                raise ValueError(f"records of {path} can't be told apart at {end >> 16}; use larger splitBytes")


class BamSource(D.DataSource):
    """``spark.read.format("readqc_bam").schema(columns).load(path)``: the columns of reads that the schema names, all of them without one.

    Options: splitBytes, compressed bytes a task; files, a JSON list of (path, size) in place of the path's own listing.
    """

    @classmethod
    def name(cls):
        return "readqc_bam"

    def schema(self):
        return READS

    def reader(self, schema):
        return BamReader(schema, {k.lower(): v for k, v in self.options.items()})


def _schema_of(columns: list[str] | None) -> str:
    """The part of READS that has these columns."""
    kinds = dict(f.split(" ", 1) for f in READS.replace("op:string,len:int", "\0").split(", "))
    return ", ".join(f"{c} {k}" for c, k in kinds.items() if columns is None or c in columns).replace("\0", "op:string,len:int")


def bam(spark: SparkSession, path: str, columns: list[str] | None = None, split_bytes: int = 64 << 20) -> DataFrame:
    """Reads of a BAM file, or of the files of a folder or pattern that share one dictionary; only these columns, if given.

    read_id rises in the order of the files and of the records in them, and is the same in every scan.
    """
    found = bgzf.files(spark, path)
    found = [f for f in found if f[0].endswith(".bam")] or found  # a folder may hold indexes, too
    if not bgzf.reachable(found[0][0]):
        rows = by_blocks(spark, path)
        return rows if columns is None else rows.select(*[c for c in rows.columns if c in columns])
    spark.dataSource.register(BamSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("readqc_bam").schema(_schema_of(columns)).option("files", json.dumps(found)).option("splitBytes", split_bytes).load(path)


class Spans(dict):
    """Merged intervals: reference number to sorted arrays (starts, ends)."""

    def hit(self, records: Records) -> np.ndarray:
        """Which records overlap an interval."""
        out, ends = np.zeros(len(records.at), bool), records.ends()
        for ref in np.unique(records.fixed["ref"]):
            if int(ref) in self:
                starts, stops = self[int(ref)]
                own = np.flatnonzero((records.fixed["ref"] == ref) & (ends >= 0))
                at = np.searchsorted(stops, records.fixed["pos"][own], "right")  # the first interval that ends after the read's start
                out[own] = (at < len(starts)) & (starts[np.minimum(at, len(starts) - 1)] < ends[own])
        return out


def _indexed(spark: SparkSession, path: str, regions: list[tuple[str, int, int]], columns: list[str] | None, split_bytes: int) -> DataFrame | None:
    """Reads that overlap a region, each once, by index and within tasks; None if a file has no index or executors can't open it."""
    _, names, _ = read_header(spark, path)
    if unknown := [c for c, _, _ in regions if c not in names]:
        raise ValueError(f"unknown contig: {unknown[0]}")
    files = bgzf.files(spark, path)
    files = [f for f in files if f[0].endswith(".bam")] or files
    if not bgzf.reachable(files[0][0]):
        return None
    number = {n: i for i, n in enumerate(names)}
    spans = Spans()
    for ref in {number[c] for c, _, _ in regions}:
        own = bgzf.merged_ranges([(s, e) for c, s, e in regions if number[c] == ref and e > s])
        if own:
            spans[ref] = tuple(np.array(x, np.int64) for x in zip(*own))
    groups, shift = [], place_bits(files)
    for file_no, (file, _) in enumerate(files):
        index = bgzf.find_index(spark, file, (".bai", ".csi"))
        if index is None:
            return None
        chunks = bgzf.merged_ranges([c for ref, (starts, ends) in spans.items() for s, e in zip(starts.tolist(), ends.tolist()) for c in index.chunks(ref, s, e)])
        groups += [(file_no, file, g) for g in bgzf.grouped(chunks, split_bytes)]
    schema = _schema_of(columns)
    want = [f.split(" ")[0] for f in schema.split(", ")]
    sent = spark.sparkContext.broadcast((names, spans, groups))

    def work(batches):
        names, spans, groups = sent.value
        for batch in batches:
            for group in batch.column("id").to_pylist():
                file_no, file, ranges = groups[group]
                stretch = Stretch(file, names)
                for begin, end in ranges:
                    for records, places in stretch.records(begin, end):
                        keep = spans.hit(records)
                        if keep.any():
                            made = records.where(keep).columns([c for c in want if c != "read_id"]) | {"read_id": pa.array(file_no << shift | places[keep])}
                            yield pa.RecordBatch.from_arrays([made[c] for c in want], names=want)

    return spark.range(0, len(groups), 1, max(1, len(groups))).mapInArrow(work, schema)


def bam_region(spark: SparkSession, path: str, contig: str, start0: int, end0: int, columns: list[str] | None = None, split_bytes: int = 64 << 20) -> DataFrame:
    """Reads that overlap a region: by its BAI or CSI, a task some chunks; without index by a filtered scan."""
    rows = _indexed(spark, path, [(contig, start0, end0)], columns, split_bytes)
    if rows is None:
        rows = bam(spark, path).filter((F.col("contig") == contig) & (F.col("pos0") < end0)).filter(alignment_end() > start0)
        rows = rows if columns is None else rows.select(*[c for c in rows.columns if c in columns])
    return rows


def bam_intervals(spark: SparkSession, path: str, intervals: DataFrame, columns: list[str] | None = None, split_bytes: int = 64 << 20, most_intervals: int = 1_000_000) -> DataFrame:
    """Reads that overlap some interval, each once: by index for at most most_intervals intervals (16 MB of numbers, which tasks hold), else by a scan and a range join."""
    some = [(r.contig, r.start0, r.end0) for r in intervals.select("contig", "start0", "end0").limit(most_intervals + 1).collect()]
    rows = None if len(some) > most_intervals else _indexed(spark, path, some, columns, split_bytes)
    if rows is not None:
        return rows
    rows = stored(bam(spark, path), "reads")
    spans = rows.withColumn("a_end", alignment_end()).filter("a_end IS NOT NULL").select("read_id", "contig", F.col("pos0").alias("a_start"), "a_end")
    hit = range_join(spans, intervals.select("contig", F.col("start0").alias("b_start"), F.col("end0").alias("b_end")), "left_semi")
    rows = rows.join(hit.select("read_id"), "read_id", "left_semi")
    return rows if columns is None else rows.select(*[c for c in rows.columns if c in columns])


def bam_contigs(spark: SparkSession, path: str) -> DataFrame:
    return contigs_of(spark, read_header(spark, path)[0])
