"""Reads written as BAM, and variants as BCF: a folder of part files, each sorted, with the whole header and an index of its own.

Rows are dealt by range of position, and each task writes one file under the number of its partition; a task that runs again
writes the same file again.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bgzf
from .bam import BASES, FIELDS, OPS, READS

PAYLOAD = 65_280
_CODES = {c: i for i, c in enumerate(BASES)}
_OPS = {c: i for i, c in enumerate(OPS)}
_CODE_OF = np.array([_CODES.get(chr(c).upper(), 15) for c in range(128)], np.uint8)
AT_ONCE = 4 << 20


def bin_of(start: int, end: int) -> int:
    """The smallest bin of the format's scheme of six levels that holds [start, end)."""
    for level in range(5, 0, -1):
        shift = 14 + 3 * (5 - level)
        if start >> shift == (end - 1) >> shift:
            return ((1 << 3 * level) - 1) // 7 + (start >> shift)
    return 0


def header(lines: list[str], contigs: list[tuple[str, int]]) -> bytes:
    text = "".join(f"{x}\n" for x in lines).encode()
    out = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(contigs))
    return out + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in contigs)


def record(r: dict) -> tuple[bytes, int]:
    """The bytes of a read, and its exclusive end on the reference (its start + 1 without span)."""
    ops, seq, pos = r["cigar"] or [], r["seq"] or "", -1 if r["pos0"] is None else r["pos0"]
    name = (r["qname"] or "*").encode() + b"\0"
    end = pos + (sum(o["len"] for o in ops if o["op"] in "MDN=X") or 1)
    or_none = lambda v: -1 if v is None else v
    codes = [_CODES.get(c, 15) for c in seq.upper()] + [0]
    quals = r["quals"].encode("latin-1") if r["quals"] else b""
    body = struct.pack("<iiBBHHHiiii", or_none(r["ref_id"]), pos, len(name), 255 if r["mapq"] is None else r["mapq"], bin_of(max(pos, 0), max(end, 1)), len(ops), r["flags"], len(seq), or_none(r["mate_ref_id"]), or_none(r["mate_pos0"]), r["tlen"] or 0)
    body += name + b"".join(struct.pack("<I", o["len"] << 4 | _OPS[o["op"]]) for o in ops)
    body += bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(seq), 2)) + (bytes(q - 33 for q in quals) if len(quals) == len(seq) else b"\xff" * len(seq))
    body += b"".join(tag + b"i" + struct.pack("<i", r[c]) for tag, c in ((b"NM", "nm"), (b"MQ", "mq")) if r[c] is not None)
    body += b"SAZx\0" if r["has_sa"] else b""
    return struct.pack("<i", len(body)) + body, end


def _bins_of(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """bin_of() of each pair."""
    out = np.zeros(len(start), np.int64)
    for level in range(1, 6):
        shift = 14 + 3 * (5 - level)
        out = np.where(start >> shift == (end - 1) >> shift, ((1 << 3 * level) - 1) // 7 + (start >> shift), out)
    return out


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each span, one after the other."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)


def _text(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, size, bytes) of texts; a null is empty."""
    binary = column.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1] if len(binary) else np.zeros(1, np.int64)
    return ends[:-1] - ends[0], np.diff(ends), np.frombuffer(binary.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]


def _number(column: pa.Array, least: int, most: int, missing: int | None = None) -> np.ndarray:
    """Numbers within what their field holds; missing stands for null, which is an error without it."""
    if missing is None and column.null_count:
        raise ValueError("a read without flags")
    out = column.cast(pa.int64()).fill_null(missing if missing is not None else 0).to_numpy(zero_copy_only=False)
    if len(out) and not (least <= out.min() and out.max() <= most):
        raise struct.error(f"a number of a read is not within {least} and {most}")
    return out


def records(batch: pa.RecordBatch) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, where each ends, reference, start, end) of reads, as record() gives them one by one; reference and start are -1 for null."""
    col, n = lambda name: batch.column(batch.schema.get_field_index(name)), batch.num_rows
    i32 = (-(1 << 31), (1 << 31) - 1)
    name_at, name_size, names = _text(pc.if_else(pc.equal(pc.fill_null(col("qname"), ""), ""), "*", col("qname")))
    seq_at, n_seq, seq = _text(col("seq"))
    qual_at, qual_size, quals = _text(col("quals"))
    n_ops, ops = pc.list_value_length(col("cigar")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), col("cigar").flatten()
    op = pc.index_in(ops.field("op"), pa.array(list(OPS)))
    if any((x >= 128).any() for x in (seq, quals)) or op.null_count:  # the rare texts that are not ASCII, and the error for an unknown operation
        made = [record(r) for r in batch.to_pylist()]
        ref, pos = (_number(col(c), *i32, -1) for c in ("ref_id", "pos0"))
        return b"".join(m[0] for m in made), np.cumsum([len(m[0]) for m in made]), ref, pos, np.array([m[1] for m in made], np.int64)
    op, length = op.to_numpy(zero_copy_only=False).astype(np.int64), _number(ops.field("len"), 0, (1 << 28) - 1)
    pos = _number(col("pos0"), *i32, -1)
    along = np.concatenate([[0], np.cumsum(np.where(np.isin(op, [_OPS[o] for o in "MDN=X"]), length, 0))])
    ends = np.cumsum(n_ops)
    span = along[ends] - along[ends - n_ops]
    end = pos + np.where(span > 0, span, 1)
    tags = [(tag, col(c).is_valid().to_numpy(zero_copy_only=False), _number(col(c), *i32, 0)) for tag, c in ((b"NM", "nm"), (b"MQ", "mq"))]
    sa = col("has_sa").fill_null(False).to_numpy(zero_copy_only=False)
    half = (n_seq + 1) // 2
    if (name_size > 254).any() or (n_ops > 65_535).any():
        raise struct.error("a read has a longer name or more operations than BAM holds")
    fixed = np.zeros(n, FIELDS)
    size = 36 + name_size + 1 + 4 * n_ops + half + n_seq + 7 * tags[0][1] + 7 * tags[1][1] + 5 * sa
    stop = np.cumsum(size)
    begin = stop - size
    for field, values in {
        "size": size - 4, "ref": _number(col("ref_id"), *i32, -1), "pos": pos, "n_name": name_size + 1, "mapq": _number(col("mapq"), 0, 255, 255), "bin": _bins_of(np.maximum(pos, 0), np.maximum(end, 1)), "n_ops": n_ops,
        "flags": _number(col("flags"), 0, 65_535), "n_seq": n_seq, "mate": _number(col("mate_ref_id"), *i32, -1), "mate_pos": _number(col("mate_pos0"), *i32, -1), "tlen": _number(col("tlen"), *i32, 0),
    }.items():
        fixed[field] = values
    out = np.zeros(int(stop[-1]) if n else 0, np.uint8)
    out[begin[:, None] + np.arange(36)] = fixed.view(np.uint8).reshape(n, 36)
    at = begin + 36
    out[_places(at, name_size)] = names[_places(name_at, name_size)]
    at = at + name_size + 1
    out[_places(at, 4 * n_ops)] = (length << 4 | op).astype("<u4").view(np.uint8)
    at = at + 4 * n_ops
    codes = np.zeros(2 * int(half.sum()), np.uint8)
    codes[_places(np.cumsum(2 * half) - 2 * half, n_seq)] = _CODE_OF[seq[_places(seq_at, n_seq)]]
    out[_places(at, half)] = codes[::2] << 4 | codes[1::2]
    at = at + half
    scored = np.where(qual_size == n_seq, n_seq, 0)
    chars = quals[_places(qual_at, scored)]
    if len(chars) and chars.min() < 33:
        raise ValueError("a quality is below 0")
    out[_places(at, n_seq - scored)] = 255
    out[_places(at, scored)] = chars - np.uint8(33)
    at = at + n_seq
    for tag, there, values in tags:
        own = np.zeros((int(there.sum()), 7), np.uint8)
        own[:, :3] = np.frombuffer(tag + b"i", np.uint8)
        own[:, 3:] = values[there].astype("<i4").view(np.uint8).reshape(-1, 4)
        out[at[there][:, None] + np.arange(7)] = own
        at = at + 7 * there
    out[at[sa][:, None] + np.arange(5)] = np.frombuffer(b"SAZx\0", np.uint8)
    return out.tobytes(), stop, fixed["ref"].astype(np.int64), pos, end


def _slices(batch: pa.RecordBatch):
    """A batch in parts of about AT_ONCE bases and operations."""
    size = sum(pc.fill_null(f(batch.column(batch.schema.get_field_index(c))), 0).to_numpy(zero_copy_only=False).astype(np.int64) for f, c in ((pc.binary_length, "seq"), (pc.list_value_length, "cigar")))
    ends, lo = np.cumsum(size + 50), 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + AT_ONCE, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


class Writer:
    """BGZF blocks of a sorted stream of records, and the bins of its index."""

    def __init__(self, out, head: bytes, refs: int):
        self.out, self.held, self.at = out, bytearray(), 0
        self.starts = [0]  # where the blocks begin that hold the records of one add_all()
        self.bins: list[dict[int, list[list[int]]]] = [{} for _ in range(refs)]
        self.linear: list[dict[int, int]] = [{} for _ in range(refs)]
        self._put(head)

    def _flush(self, size: int) -> None:
        data = bytes(self.held[:size])
        del self.held[:size]
        c = zlib.compressobj(4, zlib.DEFLATED, -15)
        packed = c.compress(data) + c.flush()
        block = bgzf.MAGIC + struct.pack("<H", len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(data), len(data))
        self.out.write(block)
        self.at += len(block)
        self.starts.append(self.at)

    def _put(self, data: bytes) -> None:
        self.held += data
        while len(self.held) >= PAYLOAD:
            self._flush(PAYLOAD)

    def add(self, data: bytes, ref: int | None, start: int | None, end: int) -> None:
        """A record that lies at [start, end) of a reference, or nowhere."""
        begin = self.at << 16 | len(self.held)
        self._put(data)
        if ref is not None and start is not None:
            chunks = self.bins[ref].setdefault(bin_of(start, end), [])
            place = self.at << 16 | len(self.held)
            if chunks and chunks[-1][1] == begin:
                chunks[-1][1] = place
            else:
                chunks.append([begin, place])
            for w in range(start >> 14, (end - 1 >> 14) + 1):
                self.linear[ref].setdefault(w, begin)

    def add_all(self, data: bytes, stop: np.ndarray, ref: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """add() for records that end at stop; -1 is no reference, no start. Neighbours of one bin and one set of windows are entered once."""
        self.starts, first = [self.at], len(self.held)
        self._put(data)
        if not len(stop):
            return
        place = lambda at: np.array(self.starts, np.int64)[(first + at) // PAYLOAD] << 16 | (first + at) % PAYLOAD
        begins, stops = place(np.concatenate([[0], stop[:-1]])), place(stop)
        placed = (ref >= 0) & (start >= 0)
        keys = np.where(placed, [ref, _bins_of(start, end), start >> 14, (end - 1) >> 14], -1)
        heads = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
        lasts = np.append(heads[1:], len(stop)) - 1
        for (r, number, low, high), begin, after in zip(keys[:, heads].T.tolist(), begins[heads].tolist(), stops[lasts].tolist()):
            if r < 0:
                continue
            chunks = self.bins[r].setdefault(number, [])
            if chunks and chunks[-1][1] == begin:
                chunks[-1][1] = after
            else:
                chunks.append([begin, after])
            for w in range(low, high + 1):
                self.linear[r].setdefault(w, begin)

    def close(self) -> None:
        """Writes what is left and the empty block at the end."""
        if self.held:
            self._flush(len(self.held))
        self._flush(0)

    def bai(self) -> bytes:
        index = b"BAI\x01" + struct.pack("<i", len(self.bins))
        for bins, linear in zip(self.bins, self.linear, strict=True):
            index += struct.pack("<i", len(bins))
            for number, chunks in bins.items():
                index += struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
            top, last = max(linear, default=-1) + 1, 0
            index += struct.pack("<i", top)
            for w in range(top):
                last = linear.get(w, last)
                index += struct.pack("<Q", last)
        return index

    def csi(self) -> bytes:
        """The same bins as CSI; a bin's own offset is that of its first chunk."""
        index = b"CSI\x01" + struct.pack("<iiii", 14, 5, 0, len(self.bins))
        for bins in self.bins:
            index += struct.pack("<i", len(bins))
            for number, chunks in bins.items():
                index += struct.pack("<IQi", number, chunks[0][0], len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
        return index


def _written(rows: DataFrame, path: str, ending: str, head: bytes, refs: int, encode=None) -> int:
    """Each partition of rows as one file of records encode(row) = (bytes, reference, start, end), and its index; returns their number. Without encode, records() encodes reads batch by batch. path must be in a store that pyarrow opens."""

    def work(batches):
        system, inside = bgzf.opened(path)
        system.create_dir(inside, recursive=True)
        file, n = f"{inside}/part-{TaskContext.get().partitionId():05d}{ending}", 0
        with system.open_output_stream(file) as out:
            writer = Writer(out, head, refs)
            for batch in batches:
                n += batch.num_rows
                if encode is None:
                    for part in _slices(batch):
                        writer.add_all(*records(part))
                    continue
                for r in batch.to_pylist():
                    writer.add(*encode(r))
            writer.close()
        with system.open_output_stream(file + (".bai" if ending == ".bam" else ".csi")) as out:
            out.write(writer.bai() if ending == ".bam" else writer.csi())
        yield pa.RecordBatch.from_pydict({"n": [n]})

    return rows.mapInArrow(work, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _named(contigs: DataFrame) -> list[tuple[str, int]]:
    """(name, length) in order; contigs has one row a contig."""
    return [(r.contig, r.length) for r in contigs.orderBy("ref_id").collect()]


def write_bam(reads: DataFrame, contigs: DataFrame, path: str, lines: tuple[str, ...] = (), parts: int | None = None) -> int:
    """Writes reads as files path/part-N.bam with BAI; returns their number."""
    names = _named(contigs)
    head = header([*lines, *(f"@SQ\tSN:{n}\tLN:{size}" for n, size in names)], names)
    columns = [c.split(" ")[0] for c in READS.replace("op:string,len:int", "").split(", ")]
    order = [F.col("ref_id").asc_nulls_last(), F.col("pos0").asc_nulls_last(), F.col("read_id")]
    dealt = reads.select(*columns).repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order)
    return _written(dealt, path, ".bam", head, len(names))


def placed_record(r: dict) -> tuple[bytes, int | None, int | None, int]:
    data, end = record(r)
    return data, r["ref_id"], r["pos0"], end


def bcf_header(contigs: list[tuple[str, int]]) -> bytes:
    text = "##fileformat=VCFv4.3\n" + "".join(f"##contig=<ID={n},length={size}>\n" for n, size in contigs) + "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n"
    return b"BCF\x02\x02" + struct.pack("<I", len(text) + 1) + text.encode() + b"\0"


def _typed_text(text: str) -> bytes:
    data = text.encode()
    return bytes([len(data) << 4 | 7]) + data if len(data) < 15 else bytes([0xF7, 0x12]) + struct.pack("<H", len(data)) + data


def bcf_record(ref: int, start: int, size: int, name: str | None, bases: str = "A", other: str = "C") -> bytes:
    """A variant without INFO values, filters and samples; size is the length of its span."""
    shared = struct.pack("<iiiI", ref, start, size, 0x7F800001) + struct.pack("<II", 2 << 16, 0) + _typed_text(name or "") + _typed_text(bases) + _typed_text(other) + b"\x00"
    return struct.pack("<II", len(shared), 0) + shared


def write_bcf(variants: DataFrame, contigs: DataFrame, path: str) -> int:
    """Writes spans (contig, start0, end0, name) as files path/part-N.bcf with CSI; returns their number."""
    names = _named(contigs)
    number = {n: i for i, (n, _) in enumerate(names)}
    dealt = variants.select("contig", "start0", "end0", "name").repartitionByRange("contig", "start0").sortWithinPartitions("contig", "start0", "end0")
    encode = lambda r: (bcf_record(number[r["contig"]], r["start0"], r["end0"] - r["start0"], r["name"]), number[r["contig"]], r["start0"], max(r["end0"], r["start0"] + 1))
    return _written(dealt, path, ".bcf", bcf_header(names), len(names), encode)
