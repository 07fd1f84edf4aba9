"""FASTA files as a Spark data source of tiles.

With an index (``.fai``) a file is read in pieces of about ``SPLIT`` bytes, each the whole tiles of one contig: the index
says where in the file a base stands. Without one, and for gzipped files, a file is one piece that is read from
start to end, line by line. Either way work is in proportion to the file, and a task holds one piece's buffer or one tile.
A record starts where a line starts with ``>``; its name goes up to the first white space, and what follows is of no interest.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import open_input

#: Bases in a row of the genome's tiles.
TILE = 1024
SCHEMA = "contig string, tile bigint, seq string"
#: Bytes of a piece; pieces end with tiles.
SPLIT = 8 << 20
BATCH = 2048
_ARROW = pa.schema([("contig", pa.string()), ("tile", pa.int64()), ("seq", pa.string())])
_BREAKS = b" \t\r\n"


@dataclass
class Piece(InputPartition):
    path: str
    contig: str | None = None
    #: Bases of the contig, and the first and the end of those that are read.
    first: int = 0
    end: int = 0
    #: Where the contig's first base stands, bases of a line, and bytes of a line with its break.
    offset: int = 0
    bases: int = 1
    width: int = 1


def index_of(lines: Iterator[str]) -> list[tuple[str, int, int, int, int]]:
    """(contig, length, offset, bases of a line, bytes of a line) of the lines of a ``.fai`` file."""
    out = []
    for line in lines:
        name, *numbers = line.rstrip("\r\n").split("\t")
        if name:
            out.append((name, *map(int, numbers[:4])))
    return out


def make_index(path: str) -> str:
    """The text of the index of a plain file, read once from start to end; lines of a record must be of one length but for its last."""
    out, at, name = [], 0, None
    length = offset = bases = width = 0
    ended = False
    with open_input(path) as raw:
        for line in io.BufferedReader(raw) if not isinstance(raw, io.BufferedReader) else raw:
            if line.startswith(b">"):
                if name is not None:
                    out.append(f"{name}\t{length}\t{offset}\t{bases or 1}\t{width or 1}\n")
                name, length, offset, bases, width, ended = (line[1:].split() or [b""])[0].decode(), 0, at + len(line), 0, 0, False
            elif own := len(line.rstrip(_BREAKS)):
                if ended or bases and own > bases:
                    raise ValueError(f"lines of {name} in {path} differ in length")
                bases, width = bases or own, width or len(line)
                ended, length = own < bases, length + own
            else:
                ended = True
            at += len(line)
    if name is not None:
        out.append(f"{name}\t{length}\t{offset}\t{bases or 1}\t{width or 1}\n")
    return "".join(out)


class FastaReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p.strip() for p in options["path"].split(",") if p.strip()]
        self.split = max(1, int(options.get("split", SPLIT)) // TILE) * TILE

    def partitions(self) -> Sequence[InputPartition]:
        return [piece for path in self.paths for piece in self._pieces(path)]

    def _pieces(self, path: str) -> list[Piece]:
        with open_input(path) as f:
            zipped = f.read(2) == b"\x1f\x8b"
        try:
            with open_input(f"{path}.fai") as f:
                listed = index_of(io.TextIOWrapper(io.BytesIO(f.read())))
        except OSError:
            listed = None
        if zipped or listed is None:
            return [Piece(path)]
        return [
            Piece(path, contig, first, min(first + self.split, length), offset, bases, width)
            for contig, length, offset, bases, width in listed
            for first in range(0, length, self.split)
        ]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in _whole(partition.path) if partition.contig is None else _part(partition):
            rows.append(row)
            if len(rows) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def _part(p: Piece) -> Iterator[tuple[str, int, str]]:
    place = lambda base: p.offset + base // p.bases * p.width + base % p.bases
    with open_input(p.path) as f:
        f.seek(place(p.first))
        seq = f.read(place(p.end - 1) + 1 - place(p.first)).translate(None, _BREAKS)
    for at in range(0, len(seq), TILE):
        yield p.contig, (p.first + at) // TILE, seq[at : at + TILE].decode("ascii", "replace")


def _whole(path: str) -> Iterator[tuple[str, int, str]]:
    contig, tile, held = None, 0, b""
    with open_input(path) as raw:
        zipped = raw.read(2) == b"\x1f\x8b"
        raw.seek(0)
        for line in gzip.GzipFile(fileobj=raw) if zipped else io.BufferedReader(raw) if not isinstance(raw, io.BufferedReader) else raw:
            if line.startswith(b">"):
                if held:
                    yield contig, tile, held.decode("ascii", "replace")
                contig, tile, held = (line[1:].split() or [b""])[0].decode(), 0, b""
            elif contig is not None:
                held += line.translate(None, _BREAKS)
                whole = len(held) // TILE * TILE
                for at in range(0, whole, TILE):
                    yield contig, tile, held[at : at + TILE].decode("ascii", "replace")
                    tile += 1
                held = held[whole:]
    if held:
        yield contig, tile, held.decode("ascii", "replace")


class FastaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FastaReader(dict(self.options))


def read_fasta(spark: SparkSession, *paths: str, split: int = SPLIT) -> DataFrame:
    """Tiles (contig, tile, seq) of TILE bases."""
    spark.dataSource.register(FastaSource)
    return spark.read.format("fasta").option("split", str(split)).load(",".join(paths))
