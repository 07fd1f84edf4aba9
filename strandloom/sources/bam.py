"""BAM files as a Spark data source.

``spark.dataSource.register(BamSource)`` and then ``spark.read.format("bam").load(path)`` give a row per
alignment. With an index (``.bai``) a file is read in pieces: the index's linear offsets are places
where records start, so pieces of about ``SPLIT`` compressed bytes are cut there, and a region
(options ``contig``, ``start``, ``end``) reads the pieces that can hold it. Without one, a file is
one piece. BGZF blocks are gzip members and are inflated one at a time, so a task holds one block and
one batch of rows. Paths are local or any URI that pyarrow knows (several with commas).

Positions are from 0; unmapped records have a null contig. ``read_id`` is the record's place: file,
block, offset in the block, so equal names never meet and a file given twice counts twice.
"""

from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import open_input, open_output

SCHEMA = "read_id bigint, contig string, pos bigint, flags int, mapq int, cigar string, seq string, qual string, name string"
#: Compressed bytes of a piece.
SPLIT = 32 << 20
#: Compressed bytes between two ranges that are read over rather than sought.
GAP = 1 << 20
#: Ranges of whole index windows that a read is narrowed to at most; with more all is read and filtered.
MOST_RANGES = 50_000
BATCH = 4096
BASES, OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
EOF_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


class Blocks:
    """A BGZF file from a virtual offset on: 48 bits of the block's place and 16 bits inside it."""

    def __init__(self, path: str, start: int = 0) -> None:
        self.file = open_input(path)
        self.place, self.next = start >> 16, start >> 16
        self.data, self.at = b"", 0
        if self._load():
            self.at = start & 0xFFFF

    def _load(self) -> bool:
        """The next block that holds data; False at the file's end."""
        while True:
            self.file.seek(self.next)
            head = self.file.read(18)
            if len(head) < 18:
                self.data, self.at = b"", 0
                return False
            if head[:4] != b"\x1f\x8b\x08\x04":
                raise ValueError("not a BGZF block")
            extra = head[12:] + self.file.read(max(0, struct.unpack("<H", head[10:12])[0] - 6))
            size, k = 0, 0
            while k + 4 <= len(extra):
                kind, length = extra[k : k + 2], struct.unpack("<H", extra[k + 2 : k + 4])[0]
                if kind == b"BC":
                    size = struct.unpack("<H", extra[k + 4 : k + 6])[0] + 1
                k += 4 + length
            packed = self.file.read(size - 12 - len(extra) - 8)
            self.place, self.next = self.next, self.next + size
            self.data, self.at = zlib.decompress(packed, -15), 0
            if self.data:
                return True

    @property
    def offset(self) -> int:
        """Where the next byte is."""
        if self.at >= len(self.data):
            return self.next << 16
        return self.place << 16 | self.at

    def read(self, n: int) -> bytes:
        """Up to ``n`` bytes; fewer only at the file's end."""
        parts = []
        while n:
            if self.at >= len(self.data) and not self._load():
                break
            part = self.data[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            parts.append(part)
        return b"".join(parts)

    def close(self) -> None:
        self.file.close()


def read_header(blocks: Blocks) -> list[tuple[str, int]]:
    """(contig, length) in the file's order; leaves ``blocks`` at the first record."""
    if blocks.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    blocks.read(struct.unpack("<i", blocks.read(4))[0])
    out = []
    for _ in range(struct.unpack("<i", blocks.read(4))[0]):
        name = blocks.read(struct.unpack("<i", blocks.read(4))[0])[:-1].decode()
        out.append((name, struct.unpack("<i", blocks.read(4))[0]))
    return out


def linear_offsets(index: bytes) -> list[list[int]]:
    """By contig: the virtual offsets of a ``.bai`` file's 16 kb windows."""
    if index[:4] != b"BAI\1":
        raise ValueError("not a BAI index")
    at, out = 8, []
    for _ in range(struct.unpack_from("<i", index, 4)[0]):
        bins = struct.unpack_from("<i", index, at)[0]
        at += 4
        for _ in range(bins):
            at += 8 + 16 * struct.unpack_from("<i", index, at + 4)[0]
        windows = struct.unpack_from("<i", index, at)[0]
        out.append(list(struct.unpack_from(f"<{windows}Q", index, at + 4)))
        at += 4 + 8 * windows
    return out


_FIXED = struct.Struct("<iiBBHHHiiii")
#: From the hexadecimal digits of a packed sequence to its letters, and from a quality to its mark.
_LETTERS = str.maketrans("0123456789abcdef", BASES)
_MARKS = bytes(min(q + 33, 126) for q in range(256))


def decode(record: bytes, contigs: list[str]) -> tuple:
    """One alignment: all columns but read_id."""
    contig, pos, name_size, mapq, _, operations, flags, length, *_ = _FIXED.unpack_from(record)
    at = 32 + name_size
    name = record[32 : at - 1].decode()
    cigar = "".join(f"{op >> 4}{OPERATIONS[op & 15]}" for op in struct.unpack_from(f"<{operations}I", record, at)) or "*"
    at += 4 * operations
    packed = record[at : at + (length + 1) // 2]
    seq = packed.hex().translate(_LETTERS)[:length]
    at += len(packed)
    qual = record[at : at + length].translate(_MARKS).decode("ascii")
    return contigs[contig] if contig >= 0 else None, pos, flags, mapq, cigar, seq, qual, name


@dataclass
class Piece(InputPartition):
    path: str
    number: int
    start: int
    end: int | None
    #: Of a piece for ranges: their contig, and which of its ranges are this piece's.
    contig: str | None = None
    first: int = 0
    last: int = 0


Ranges = dict[str, list[tuple[int, int]]]


def merged(ranges: Iterable[tuple[str, int, int]]) -> Ranges:
    """By contig: ranges in order, those that touch as one."""
    out: Ranges = {}
    for contig, start, end in sorted(ranges):
        own = out.setdefault(contig, [])
        if own and start <= own[-1][1]:
            own[-1] = (own[-1][0], max(own[-1][1], end))
        elif end > start:
            own.append((start, end))
    return out


def first_met(ranges: list[tuple[int, int]], start: int, end: int) -> int:
    """The number of the first of ``ranges`` that an alignment overlaps, or -1."""
    k = bisect_right(ranges, start, key=lambda r: r[1])
    return k if k < len(ranges) and ranges[k][0] < end else -1


class BamReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p.strip() for p in options["path"].split(",") if p.strip()]
        self.ranges: Ranges | None = None
        if "ranges" in options:
            self.ranges = {c: [tuple(r) for r in rs] for c, rs in json.loads(options["ranges"]).items()}
        elif "contig" in options:
            self.ranges = merged([(options["contig"], int(options.get("start", 0)), int(options.get("end", 2**62)))])
        self.split = int(options.get("split", SPLIT))

    def partitions(self) -> Sequence[InputPartition]:
        return [piece for k, path in enumerate(self.paths) for piece in self._pieces(k, path)]

    def _pieces(self, number: int, path: str) -> list[Piece]:
        blocks = Blocks(path)
        names = [n for n, _ in read_header(blocks)]
        start = blocks.offset
        blocks.close()
        if self.ranges is not None and self.ranges.keys().isdisjoint(names):
            return []
        try:
            with open_input(f"{path}.bai") as f:
                windows = linear_offsets(f.read())
        except OSError:
            return [Piece(path, number, start, None)]
        if self.ranges is not None:
            return [p for contig, own in self.ranges.items() if contig in names for p in self._for_ranges(path, number, contig, own, windows[names.index(contig)])]
        cuts = [start]
        for o in sorted({o for w in windows for o in w if o}):
            if (o >> 16) - (cuts[-1] >> 16) >= self.split:
                cuts.append(o)
        return [Piece(path, number, a, b) for a, b in zip(cuts, [*cuts[1:], None])]

    def _for_ranges(self, path: str, number: int, contig: str, ranges: list[tuple[int, int]], windows: list[int]) -> list[Piece]:
        """Ranges that lie near each other in the file share a piece."""
        out: list[Piece] = []
        near = 0
        for k, (low, _) in enumerate(ranges):
            at = next((o for o in windows[max(0, low) >> 14 :] if o), None)
            if at is None:
                break
            if out and (at >> 16) - near <= GAP and (at >> 16) - (out[-1].start >> 16) < self.split:
                out[-1].last = k + 1
            else:
                out.append(Piece(path, number, at, None, contig, k, k + 1))
            near = at >> 16
        return out

    def read(self, partition: Piece | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file has the contig
            return
        head = Blocks(partition.path)
        contigs = [n for n, _ in read_header(head)]
        head.close()
        blocks = Blocks(partition.path, partition.start)
        rows: list[tuple] = []
        while partition.end is None or blocks.offset < partition.end:
            place = blocks.offset
            size = blocks.read(4)
            if len(size) < 4:
                break
            record = blocks.read(struct.unpack("<i", size)[0])
            row = decode(record, contigs)
            if self.ranges is not None:
                own = self.ranges.get(row[0])
                if partition.contig is not None and (row[0] != partition.contig or row[1] >= own[partition.last - 1][1]):
                    break
                met = first_met(own, row[1], row[1] + max(1, _span(row[4]))) if own else -1
                if met < 0 or partition.contig is not None and not partition.first <= met < partition.last:
                    continue
            rows.append(((partition.number << 54) + (place & (1 << 54) - 1), *row))
            if len(rows) == BATCH:
                yield _batch(rows)
                rows = []
        blocks.close()
        if rows:
            yield _batch(rows)


def _span(cigar: str) -> int:
    total = n = 0
    for c in cigar:
        if c.isdigit():
            n = 10 * n + int(c)
        else:
            total += n * (c in "MDN=X")
            n = 0
    return total


_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=_NAMES)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BamReader(dict(self.options))


def read_bam(spark: SparkSession, *paths: str, contig: str | None = None, start: int = 0, end: int | None = None, near: DataFrame | None = None) -> DataFrame:
    """All alignments of the files together, those that overlap a region, or those near ``near`` (contig, start_, end_).

    Near: in the same window of 16 kb as a range, so that what the files' indexes can tell apart is left unread.
    """
    spark.dataSource.register(BamSource)
    reader = spark.read.format("bam")
    if contig is not None:
        reader = reader.option("contig", contig).option("start", str(start)).option("end", str(end if end is not None else 2**62))
    elif near is not None:
        window = lambda c: F.shiftright(F.greatest(F.col(c).cast("bigint"), F.lit(0)), 14)
        touched = near.where("end_ > start_ and end_ > 0").select("contig", F.explode(F.sequence(window("start_"), F.shiftright(F.col("end_").cast("bigint") - 1, 14))).alias("w")).distinct()
        held = touched.limit(MOST_RANGES + 1).collect()
        if len(held) <= MOST_RANGES:
            reader = reader.option("ranges", json.dumps(merged((r["contig"], r["w"] << 14, r["w"] + 1 << 14) for r in held)))
    return reader.load(",".join(paths))


def header_contigs(spark: SparkSession, *paths: str) -> DataFrame:
    """(contig, len) rows of all files' headers."""
    rows = []
    for path in paths:
        blocks = Blocks(path)
        rows += read_header(blocks)
        blocks.close()
    return spark.createDataFrame(rows, "contig string, len bigint")


def bgzf_block(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = packer.compress(data) + packer.flush()
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 6) + b"BC\2\0" + struct.pack("<H", len(packed) + 25)
    return head + packed + struct.pack("<II", zlib.crc32(data), len(data))


def encode(row: tuple, contigs: list[str]) -> bytes:
    """The record of (contig, pos, flags, mapq, cigar, seq, qual, name)."""
    contig, pos, flags, mapq, cigar, seq, qual, name = row
    operations, n = [], ""
    for c in cigar if cigar != "*" else "":
        if c.isdigit():
            n += c
        else:
            operations.append(int(n) << 4 | OPERATIONS.index(c))
            n = ""
    codes = [BASES.index(c) for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
    number = contigs.index(contig) if contig is not None else -1
    fixed = _FIXED.pack(number, pos, len(name) + 1, mapq, 0, len(operations), flags, len(seq), -1, -1, 0)
    body = fixed + name.encode() + b"\0" + struct.pack(f"<{len(operations)}I", *operations) + packed + bytes(ord(q) - 33 for q in qual)
    return struct.pack("<i", len(body)) + body


def write_bam(path: str, contigs: list[tuple[str, int]], rows: Iterable[tuple], block: int = 60_000, index: bool = True) -> int:
    """A BAM file of ``rows`` in the order they have, with its linear index; the number of rows. One block is in memory."""
    names = [n for n, _ in contigs]
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", len(contigs))
    for name, size in contigs:
        head += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", size)
    windows: list[dict[int, int]] = [{} for _ in contigs]
    data, at, count = b"", 0, 0
    with open_output(path) as f:

        def put(part: bytes) -> int:
            packed = bgzf_block(part)
            f.write(packed)
            return len(packed)

        at += put(head)
        for row in rows:
            count += 1
            if len(data) >= block:
                at += put(data[:block])
                data = data[block:]
            if row[0] is not None:
                own = windows[names.index(row[0])]
                for w in range(row[1] >> 14, (row[1] + max(1, _span(row[4])) - 1 >> 14) + 1):
                    own.setdefault(w, at << 16 | len(data))
            data += encode(row, names)
        while data:
            put(data[:block])
            data = data[block:]
        f.write(EOF_BLOCK)
    if index:
        with open_output(f"{path}.bai") as f:
            f.write(b"BAI\1" + struct.pack("<i", len(contigs)))
            for own in windows:
                size = max(own, default=-1) + 1
                filled, last = [], 0
                for w in range(size):
                    last = own.get(w, last)
                    filled.append(last)
                f.write(struct.pack("<ii", 0, size) + struct.pack(f"<{size}Q", *filled))
    return count


def write_parts(reads: DataFrame, folder: str, contigs: list[tuple[str, int]], parts: int) -> list[str]:
    """Sorted BAM files with indexes, ``parts`` at most, each written by a task; their paths. ``folder`` is shared by all executors."""
    columns = ["contig", "pos", "flags", "mapq", "cigar", "seq", "qual", "name"]
    ordered = reads.select(*columns).repartitionByRange(parts, "contig", "pos", "name").sortWithinPartitions("contig", "pos", "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        path = f"{folder}/part-{task.partitionId():05d}-{task.attemptNumber()}.bam"  # a second attempt has a file of its own
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        count = write_bam(path, contigs, rows)
        yield pa.RecordBatch.from_pydict({"path": [path], "n": [count]})

    return [r["path"] for r in ordered.mapInArrow(run, "path string, n long").collect() if r["n"]]
