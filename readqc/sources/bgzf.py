"""Blocked gzip (BGZF): splittable scans by Spark's text reader, byte ranges, and the indexes BAI, CSI and TBI.

A BGZF block begins with a fixed header whose last bytes are the same in every block. Taken as the line separator they
make every block one line of Spark's text reader, which splits files and reads any store that Spark reads.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: what stands before the size of each block, and the parts of it on both sides of the separator.
MAGIC = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x06\x00BC\x02\x00"
SEPARATOR, BEFORE = MAGIC[10:], MAGIC[:10]
BLOCK = 1 << 16


def files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, length) of the files under a path or pattern, in order of their paths."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs, out = p.getFileSystem(conf), []
    for found in fs.globStatus(p) or []:
        for s in fs.listStatus(found.getPath()) if found.isDirectory() else [found]:
            if s.isFile() and not s.getPath().getName().startswith(("_", ".")):
                out.append((s.getPath().toString(), s.getLen()))
    if not out:
        raise FileNotFoundError(path)
    return sorted(out)


def read_range(spark: SparkSession, path: str, start: int, size: int) -> bytes:
    """Bytes of a file from any store that Spark reads; at most size, brought to the driver."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    size = min(size, fs.getFileStatus(p).getLen() - start)
    if size <= 0:
        return b""
    stream = fs.open(p)
    try:
        stream.seek(start)
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size))
    finally:
        stream.close()


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, b): b is one block from its size field on, followed by the first bytes of the next block. Rows of a split come in order; the first row of a file holds no block."""
    rows = spark.read.option("lineSep", SEPARATOR.decode()).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("b"))


class Inflater:
    """Blocks to bytes. A separator that occurs by chance inside compressed data cuts a block; its parts are put together again."""

    def __init__(self):
        self.held = b""

    def __call__(self, b: bytes) -> bytes:
        whole = self.held + SEPARATOR + b if self.held else b
        d = zlib.decompressobj(-15)
        out = d.decompress(whole[2:])
        self.held = b"" if d.eof else whole
        if len(self.held) > 2 * BLOCK:
            raise ValueError("not a BGZF file, or a broken block")
        return out if d.eof else b""


def inflate(data: bytes) -> bytes:
    """The bytes of the whole blocks at the beginning of data."""
    out, at = [], 0
    while at + 18 <= len(data):
        if data[at + 10 : at + 16] != SEPARATOR:
            raise ValueError("not a BGZF file")
        size = struct.unpack_from("<H", data, at + 16)[0] + 1
        if at + size > len(data):
            break
        out.append(zlib.decompress(data[at : at + size], 31))
        at += size
    return b"".join(out)


@dataclass
class Index:
    """Bins of each reference with their chunks of virtual offsets, and the least offsets of the linear index."""

    shift: int
    depth: int
    bins: list[dict[int, list[tuple[int, int]]]] = field(default_factory=list)
    linear: list[list[int]] = field(default_factory=list)
    names: list[str] = field(default_factory=list)

    def starts(self) -> list[int]:
        """Places at which records start, one a chunk, in order."""
        return sorted({a for bins in self.bins for chunks in bins.values() for a, _ in chunks})

    def chunks(self, ref: int, start: int, end: int) -> list[tuple[int, int]]:
        """Virtual offset ranges that hold all records overlapping [start, end), merged."""
        if not 0 <= ref < len(self.bins) or end <= start:
            return []
        end = min(end, 1 << (self.shift + 3 * self.depth))
        found, first, shift = [], 0, self.shift + 3 * self.depth
        for level in range(self.depth + 1):
            for b in range(first + (start >> shift), first + ((end - 1) >> shift) + 1):
                found += self.bins[ref].get(b, [])
            first += 1 << 3 * level
            shift -= 3
        least = self.linear[ref][start >> 14] if ref < len(self.linear) and start >> 14 < len(self.linear[ref]) else 0
        out: list[tuple[int, int]] = []
        for a, b in sorted(c for c in found if c[1] > least):
            if out and a >> 16 <= (out[-1][1] >> 16) + BLOCK:
                out[-1] = (out[-1][0], max(out[-1][1], b))
            else:
                out.append((a, b))
        return out


def parse_index(data: bytes) -> Index:
    """BAI, TBI or CSI, the latter two also compressed."""
    if data[:2] == b"\x1f\x8b":
        data = inflate(data)
    magic, at = data[:4], 4
    if magic not in (b"BAI\x01", b"TBI\x01", b"CSI\x01"):
        raise ValueError("unknown index")
    index, names = Index(14, 5), b""
    if magic == b"CSI\x01":
        index.shift, index.depth, n = struct.unpack_from("<iii", data, at)
        at += 12
        if n >= 28:
            names = data[at + 28 : at + 28 + struct.unpack_from("<i", data, at + 24)[0]]
        at += n
    (refs,) = struct.unpack_from("<i", data, at)
    at += 4
    if magic == b"TBI\x01":
        (n,) = struct.unpack_from("<i", data, at + 24)
        names = data[at + 28 : at + 28 + n]
        at += 28 + n
    index.names = [x.decode() for x in names.split(b"\0") if x]
    for _ in range(refs):
        (n,) = struct.unpack_from("<i", data, at)
        at, bins = at + 4, {}
        for _ in range(n):
            (number,) = struct.unpack_from("<I", data, at)
            at += 12 if magic == b"CSI\x01" else 4
            (k,) = struct.unpack_from("<i", data, at)
            bins[number] = [struct.unpack_from("<QQ", data, at + 4 + 16 * i) for i in range(k)]
            at += 4 + 16 * k
        index.bins.append(bins)
        if magic != b"CSI\x01":
            (n,) = struct.unpack_from("<i", data, at)
            index.linear.append(list(struct.unpack_from(f"<{n}Q", data, at + 4)))
            at += 4 + 8 * n
    return index


def find_index(spark: SparkSession, path: str, endings: tuple[str, ...]) -> Index | None:
    """The index beside a file: path + ending, or the ending in place of the file's own."""
    for ending in endings:
        for name in (path + ending, path.rsplit(".", 1)[0] + ending):
            if exists(spark, name):
                return parse_index(read_range(spark, name, 0, 1 << 30))
    return None


# What follows runs in executors, which have no access to the files but pyarrow's.


def opened(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    if "://" not in path:
        return fs.LocalFileSystem(), path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def reachable(path: str) -> bool:
    """Whether pyarrow opens files of this kind of path."""
    try:
        opened(path)
    except Exception:  # unknown scheme, or a store whose client is missing: Spark's readers are left
        return False
    return True


def open_file(path: str):
    """(file, size)."""
    system, inside = opened(path)
    file = system.open_input_file(inside)
    return file, file.size()


def listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of a folder's files in order."""
    from pyarrow import fs

    system, inside = opened(path)
    info = system.get_file_info(inside)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(inside)) if info.type == fs.FileType.Directory else []
    out = sorted((f"{path.rstrip('/')}/{f.base_name}", f.size) for f in found if f.is_file and f.base_name[0] not in "_." and f.base_name.endswith(".bam"))
    if not out:
        raise FileNotFoundError(path)
    return out


def index_beside(path: str) -> Index | None:
    """BAI or CSI beside a file."""
    for name in (path + ".bai", path.rsplit(".", 1)[0] + ".bai", path + ".csi"):
        try:
            file, size = open_file(name)
        except FileNotFoundError:
            continue
        return parse_index(file.read_at(size, 0))
    return None


def next_block(file, size: int, begin: int) -> int | None:
    """Offset of the first block at or after an offset: MAGIC, from which another block, or the file's end, follows."""
    data, at = file.read_at(min(4 * BLOCK, size - begin), begin), 0
    while (at := data.find(MAGIC, at)) >= 0:
        if at + 18 <= len(data):
            after = at + struct.unpack_from("<H", data, at + 16)[0] + 1
            if data[after : after + 16] == MAGIC or begin + after == size:
                return begin + at
        at += 1
    return None


def inflated(file, size: int, begin: int, part: int = 1 << 20):
    """(offset, bytes) of each block from an offset on."""
    data, first, at = b"", begin, 0
    while first + at < size:
        have = len(data) - at
        if have < 18 or have < (n := struct.unpack_from("<H", data, at + 16)[0] + 1):
            data, first, at = data[at:] + file.read_at(min(part, size - first - len(data)), first + len(data)), first + at, 0
            if len(data) == have:
                raise ValueError("a BGZF file ends inside a block")
            continue
        if data[at : at + 16] != MAGIC:
            raise ValueError("not a BGZF file")
        yield first + at, zlib.decompress(data[at + 18 : at + n - 8], -15)
        at += n


def _between(file, size: int, begin: int, end: int):
    """The bytes between two places, block by block."""
    for at, block in inflated(file, size, begin >> 16):
        if at > end >> 16:
            return
        yield block[begin & 0xFFFF if at == begin >> 16 else 0 : end & 0xFFFF if at == end >> 16 else len(block)]


def _of_split(file, size: int, begin: int, end: int):
    """The bytes of the lines that begin in a split: after the first line end from its first block on (a file's first split: from its start) to the first line end from the next split's first block on."""
    start, stop = (0 if begin == 0 else next_block(file, size, begin)), next_block(file, size, end) if end < size else None
    if start is None or start >= end:
        return
    skip = begin > 0
    for at, block in inflated(file, size, start):
        last = stop is not None and at >= stop
        if skip:
            cut = block.find(b"\n")
            if last and cut >= 0:
                return
            if cut < 0:
                continue
            block, skip = block[cut + 1 :], False
        elif last and (cut := block.find(b"\n")) >= 0:
            yield block[: cut + 1]
            return
        yield block


def _lines(parts):
    """Batches (value) of the lines of consecutive bytes."""
    import pyarrow as pa

    held = b""
    for part in parts:
        held += part
        if len(held) >= 1 << 20:
            whole, _, rest = held.rpartition(b"\n")
            if whole:
                yield pa.RecordBatch.from_arrays([pa.array(whole.split(b"\n"), pa.binary()).cast(pa.string())], names=["value"])
                held = rest
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(held.removesuffix(b"\n").split(b"\n"), pa.binary()).cast(pa.string())], names=["value"])


def is_blocked(spark: SparkSession, path: str) -> bool:
    return read_range(spark, files(spark, path)[0][0], 0, 16) == MAGIC


def text_lines(spark: SparkSession, path: str, split_bytes: int = 32 << 20) -> DataFrame:
    """(value): the lines of BGZF files that executors can open, in order, a task a split."""
    splits = [(f, a, min(a + split_bytes, size)) for f, size in files(spark, path) for a in range(0, size, split_bytes)]

    def work(batches):
        for batch in batches:
            for i in batch.column("id").to_pylist():
                name, begin, end = splits[i]
                file, size = open_file(name)
                yield from _lines(_of_split(file, size, begin, end))

    return spark.range(0, len(splits), 1, len(splits)).mapInArrow(work, "value string")


def range_lines(spark: SparkSession, path: str, groups: list[list[tuple[int, int]]]) -> DataFrame:
    """(value): the lines between places of one file, a task a group of ranges; nothing comes to the driver."""
    sent = spark.sparkContext.broadcast(groups)

    def work(batches):
        for batch in batches:
            for i in batch.column("id").to_pylist():
                file, size = open_file(path)
                for begin, end in sent.value[i]:
                    yield from _lines(_between(file, size, begin, end))

    return spark.range(0, len(groups), 1, max(1, len(groups))).mapInArrow(work, "value string")


def merged_ranges(chunks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges, sorted and without overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(chunks):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def grouped(ranges: list[tuple[int, int]], size: int) -> list[list[tuple[int, int]]]:
    """Ranges of places dealt in order to groups of about size compressed bytes each."""
    out, held = [], size
    for a, b in ranges:
        if held >= size:
            out.append([])
            held = 0
        out[-1].append((a, b))
        held += (b >> 16) - (a >> 16) + BLOCK // 4
    return out
