"""BCF (binary VCF, version 2) as a Spark data source: a row per record, as ``text.parse_vcf`` gives them.

A file is one piece, as its blocks have no index of their own; a task holds one block, one record and one batch of rows.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .bam import EOF_BLOCK, Blocks, bgzf_block
from .files import open_output

SCHEMA = "contig string, pos bigint, ref string, alt string, filter_ string, gt string"
BATCH = 4096
_ARROW = pa.schema([(c.split()[0], pa.int64() if "bigint" in c else pa.string()) for c in SCHEMA.split(", ")])
#: Codes of the format's types, with how they are unpacked, and the marks of a missing value and of a vector's end.
INT8, INT16, INT32, FLOAT, CHAR = 1, 2, 3, 5, 7
_CODES = {INT8: "b", INT16: "h", INT32: "i", FLOAT: "f", CHAR: "c"}
_END = {INT8: -127, INT16: -32767, INT32: -2147483647}


def _typed(data: bytes, at: int) -> tuple[int, int, int]:
    """(type, number of values, where they start) of the descriptor at ``at``."""
    size, kind = data[at] >> 4, data[at] & 15
    at += 1
    if size == 15:
        inner, count, at = _typed(data, at)
        (size,) = struct.unpack_from(f"<{_CODES[inner]}", data, at)
        at += struct.calcsize(_CODES[inner]) * count
    return kind, size, at


def _values(data: bytes, at: int) -> tuple[list | str, int]:
    """The typed values at ``at``, a string of characters or a list, and where what follows starts."""
    kind, size, at = _typed(data, at)
    if not kind or not size:
        return [], at
    if kind == CHAR:
        return data[at : at + size].rstrip(b"\0").decode(), at + size
    found = list(struct.unpack_from(f"<{size}{_CODES[kind]}", data, at))
    return [v for v in found if v != _END.get(kind)], at + struct.calcsize(_CODES[kind]) * size


def dictionaries(header: str) -> tuple[list[str], dict[int, str]]:
    """Contigs in order, and the strings that filters and formats are numbers of."""
    contigs, strings = [], {0: "PASS"}
    for line in header.splitlines():
        if not (found := re.match(r"##(contig|FILTER|INFO|FORMAT)=<(.*)>", line)):
            continue
        name = re.search(r"(?:^|,)ID=([^,>]*)", found[2])[1]
        given = re.search(r"(?:^|,)IDX=(\d+)", found[2])
        if found[1] == "contig":
            contigs.append(name)
        elif name not in strings.values():
            strings[int(given[1]) if given else max(strings) + 1] = name
    return contigs, strings


def decode(shared: bytes, own: bytes, contigs: list[str], strings: dict[int, str]) -> tuple:
    """One record; more or fewer samples than one are an error."""
    number, pos, _, _, counts, samples = struct.unpack_from("<iiifII", shared)
    if samples & 0xFFFFFF != 1:
        raise ValueError("a BCF file must have exactly one sample")
    _, at = _values(shared, 24)
    alleles = []
    for _ in range(counts >> 16):
        allele, at = _values(shared, at)
        alleles.append(allele or ".")
    filters, _ = _values(shared, at)
    gt, at = ".", 0
    for _ in range(samples >> 24):
        (key,), at = _values(own, at)
        kind, size, at = _typed(own, at)
        if strings.get(key) == "GT":
            calls = [v for v in struct.unpack_from(f"<{size}{_CODES[kind]}", own, at) if v != _END.get(kind)]
            gt = "".join(("" if not k else "|" if v & 1 else "/") + ("." if v >> 1 <= 0 else str((v >> 1) - 1)) for k, v in enumerate(calls)) or "."
        at += struct.calcsize(_CODES[kind]) * size if kind else 0
    return contigs[number], pos, alleles[0], ",".join(alleles[1:]) or ".", ";".join(strings[f] for f in filters) or ".", gt


@dataclass
class File(InputPartition):
    path: str


class BcfReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p.strip() for p in options["path"].split(",") if p.strip()]

    def partitions(self) -> Sequence[InputPartition]:
        return [File(p) for p in self.paths]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(partition.path)
        if blocks.read(5) != b"BCF\2\2":
            raise ValueError("not a BCF file of version 2.2")
        contigs, strings = dictionaries(blocks.read(struct.unpack("<I", blocks.read(4))[0]).rstrip(b"\0").decode())
        rows: list[tuple] = []
        while len(sizes := blocks.read(8)) == 8:
            shared, own = struct.unpack("<II", sizes)
            rows.append(decode(blocks.read(shared), blocks.read(own), contigs, strings))
            if len(rows) == BATCH:
                yield _batch(rows)
                rows = []
        blocks.close()
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class BcfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bcf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BcfReader(dict(self.options))


def read_bcf(spark: SparkSession, *paths: str) -> DataFrame:
    spark.dataSource.register(BcfSource)
    return spark.read.format("bcf").load(",".join(paths))


def _text(value: str) -> bytes:
    data = value.encode()
    return (bytes([len(data) << 4 | CHAR]) if len(data) < 15 else bytes([0xF7, 0x13]) + struct.pack("<i", len(data))) + data


def write_bcf(path: str, contigs: list[tuple[str, int]], rows: list[tuple], filters: list[str]) -> None:
    """A small BCF file of (contig, pos, ref, alt, filter_, gt) rows, for tests and conversions."""
    names, numbers = [c for c, _ in contigs], {f: k + 2 for k, f in enumerate(filters)} | {"PASS": 0}
    lines = ["##fileformat=VCFv4.2", '##FORMAT=<ID=GT,Number=1,Type=String,Description="x",IDX=1>']
    lines += [f'##FILTER=<ID={f},Description="x",IDX={k}>' for f, k in numbers.items()]
    lines += [f"##contig=<ID={c},length={n}>" for c, n in contigs] + ["#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\n"]
    head = "\n".join(lines).encode() + b"\0"
    data = b"BCF\2\2" + struct.pack("<I", len(head)) + head
    for contig, pos, ref, alt, filter_, gt in rows:
        alleles = [ref, *([] if alt == "." else alt.split(","))]
        held = [] if filter_ == "." else [numbers[f] for f in filter_.split(";")]
        shared = struct.pack("<iiifII", names.index(contig), pos, len(ref), 1.0, len(alleles) << 16, 1 << 24 | 1)
        shared += b"\x07" + b"".join(map(_text, alleles)) + bytes([len(held) << 4 | INT8, *held])
        calls = [(0 if x == "." else int(x) + 1) << 1 | (k > 0 and "|" in gt) for k, x in enumerate(re.split(r"[/|]", gt))]
        own = bytes([0x11, 1, len(calls) << 4 | INT8, *calls])
        data += struct.pack("<II", len(shared), len(own)) + shared + own
    with open_output(path) as f:
        for at in range(0, len(data), 60_000):
            f.write(bgzf_block(data[at : at + 60_000]))
        f.write(EOF_BLOCK)


def write_parts(calls: DataFrame, folder: str, contigs: list[tuple[str, int]], filters: list[str], parts: int) -> list[str]:
    """BCF files of ``calls`` (SCHEMA), ``parts`` at most, sorted and each written by a task; their paths."""
    ordered = calls.select(*_ARROW.names).repartitionByRange(parts, "contig", "pos").sortWithinPartitions("contig", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        path = f"{folder}/part-{task.partitionId():05d}-{task.attemptNumber()}.bcf"  # a second attempt has a file of its own
        rows = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))]
        write_bcf(path, contigs, rows, filters)
        yield pa.RecordBatch.from_pydict({"path": [path]})

    return [r["path"] for r in ordered.mapInArrow(run, "path string").collect()]
