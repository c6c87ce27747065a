"""Grids as BOV files: a text header, and raw doubles in bricks of whole rows.

The files are a Python data source. Reading is planned from the header: a brick
of any size is cut into stretches of its rows, a task each, which read their
bytes alone; a range of rows is planned so too. (Filters are not pushed down:
Spark 4.1 keeps those of one query for the next ones of the same table.) Writing
streams the bricks that a task has, and commits by writing the header.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

#: Cells of a brick, about; a brick is at least one row of the grid.
BRICK_CELLS = 1 << 20
#: Cells that one task reads, about; at least one row.
SPLIT_CELLS = 1 << 22
#: Cells of one Arrow batch.
BATCH_CELLS = 1 << 16
SCHEMA = "i long, j long, v double"
#: The bits of the NaN that stands for a cell the grid does not have; any other NaN is a value.
ABSENT = np.uint64(0x7FF8_0000_6162_7365)


@dataclass
class Header:
    """What a header says of the grid and its bricks."""

    rows: int
    columns: int
    band: int
    pattern: str

    @staticmethod
    def parse(text: str) -> Header:
        fields = dict(re.split(r":\s*", x, maxsplit=1) for x in text.splitlines() if ":" in x)
        if fields["DATA_FORMAT"].strip() != "DOUBLE" or fields.get("DATA_ENDIAN", "LITTLE").strip() != "LITTLE":
            raise ValueError("only little-endian doubles are read")
        columns, rows = (int(x) for x in fields["DATA_SIZE"].split()[:2])
        band = int(fields["DATA_BRICKLETS"].split()[1]) if "DATA_BRICKLETS" in fields else rows
        return Header(rows, columns, max(1, band), fields["DATA_FILE"].strip())

    def text(self, time: float) -> str:
        said = {
            "TIME": time,
            "DATA_FILE": self.pattern,
            "DATA_SIZE": f"{self.columns} {self.rows} 1",
            "DATA_FORMAT": "DOUBLE",
            "VARIABLE": "v",
            "DATA_ENDIAN": "LITTLE",
            "CENTERING": "nodal",
            "DATA_BRICKLETS": f"{self.columns} {self.band} 1",
        }
        return "".join(f"{k}: {v}\n" for k, v in said.items())

    def file(self, brick: int) -> str:
        return self.pattern % brick if "%" in self.pattern else self.pattern


@dataclass
class Stretch(InputPartition):
    """Rows of one brick: a range of its bytes."""

    file: str
    first: int  # of the grid
    rows: int
    offset: int

    def bytes(self, columns: int) -> int:
        return 8 * columns * self.rows


class BovReader(DataSourceReader):
    def __init__(self, folder: str, header: Header, split_cells: int, first: int = 0, last: int | None = None):
        self.folder, self.header, self.split = folder, header, split_cells
        self.low, self.high = first, header.rows - 1 if last is None else last

    def partitions(self) -> list[Stretch]:
        head, out = self.header, []
        step = max(1, self.split // max(1, head.columns))
        low, high = max(0, self.low), min(head.rows - 1, self.high)
        for brick in range(low // head.band, high // head.band + 1 if high >= low else 0):
            first, end = max(low, brick * head.band), min(high + 1, (brick + 1) * head.band)
            for at in range(first, end, step):
                rows = min(step, end - at)
                out.append(Stretch(f"{self.folder}/{head.file(brick)}", at, rows, 8 * head.columns * (at - brick * head.band)))
        # Spark asks for at least one partition.
        return out or [Stretch("", 0, 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        columns, rows = self.header.columns, max(1, BATCH_CELLS // max(1, self.header.columns))
        if not partition.rows or not columns:
            return
        store, path = fs.FileSystem.from_uri(partition.file)
        if store.get_file_info(path).type == fs.FileType.NotFound:
            return  # a brick without a cell may be left out
        with store.open_input_file(path) as file:
            file.seek(partition.offset)
            for at in range(0, partition.rows, rows):
                size = 8 * columns * min(rows, partition.rows - at)
                raw = file.read(size)
                if len(raw) < size:
                    raise ValueError(f"{partition.file} ends before row {partition.first + at}")
                values = np.frombuffer(raw, "<f8")
                here = np.flatnonzero(values.view(np.uint64) != ABSENT)
                yield pa.RecordBatch.from_arrays([pa.array(partition.first + at + here // columns), pa.array(here % columns), pa.array(values[here])], names=["i", "j", "v"])


@dataclass
class Written(WriterCommitMessage):
    bricks: list[int]


class BovWriter(DataSourceArrowWriter):
    """Writes bricks from rows that come brick by brick (see ``write_bov``)."""

    def __init__(self, folder: str, name: str, header: Header, time: float):
        self.folder, self.name, self.header, self.time = folder, name, header, time

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder)

    def _put(self, name: str, content: bytes) -> None:
        store, folder = self._store()
        with store.open_output_stream(f"{folder}/{name}") as out:
            out.write(content)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        head, done = self.header, []
        now, values, seen = -1, None, None

        def finish() -> None:
            if values is not None:
                self._put(head.file(now), values.tobytes())
                done.append(now)

        for batch in iterator:
            i, j = batch.column("i").to_numpy(), batch.column("j").to_numpy()
            column = batch.column("v")
            v, known = column.fill_null(0.0).to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
            outside = (i < 0) | (i >= head.rows) | (j < 0) | (j >= head.columns)
            if outside.any():
                at = int(np.flatnonzero(outside)[0])
                raise ValueError(f"the cell ({i[at]}, {j[at]}) lies outside {head.rows} x {head.columns}")
            brick = i // head.band
            start = np.flatnonzero(np.r_[True, brick[1:] != brick[:-1]]).tolist() if len(i) else []
            for a, b in zip(start, [*start[1:], len(i)], strict=True):
                if brick[a] != now:
                    finish()
                    now = int(brick[a])
                    size = min(head.band, head.rows - now * head.band) * head.columns
                    values, seen = np.full(size, ABSENT).view("<f8"), np.zeros(size, bool)
                at = (i[a:b] - now * head.band) * head.columns + j[a:b]
                if seen[at].any() or len(np.unique(at)) < len(at):
                    raise ValueError(f"a cell of brick {now} comes more than once")
                seen[at] = True
                # A NaN that happens to have the bits of an absent cell becomes an ordinary one.
                own = np.where(np.isnan(v[a:b]), np.nan, v[a:b])
                values[at[known[a:b]]] = own[known[a:b]]
        finish()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        bricks = sorted(b for m in messages if m for b in m.bricks)
        if len(set(bricks)) < len(bricks):
            raise ValueError("a brick was written by more than one task")
        self._put(f"{self.name}.bov", self.header.text(self.time).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = self._store()
        for m in messages:
            for b in m.bricks if m else ():
                store.delete_file(f"{folder}/{self.header.file(b)}")


class BovSource(DataSource):
    """``spark.read.format("bov").load(header)`` and the writer behind ``write_bov``.

    Options for reading: ``split_cells``, and ``first`` and ``last`` row. The header and the bricks must be in a
    store that pyarrow can open.
    """

    @classmethod
    def name(cls) -> str:
        return "bov"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BovReader:
        from pyarrow import fs

        folder = self.options["path"].rsplit("/", 1)[0]
        store, path = fs.FileSystem.from_uri(self.options["path"])
        with store.open_input_stream(path) as file:
            header = Header.parse(file.read().decode())
        get = lambda k, default: int(self.options.get(k, default))
        return BovReader(folder, header, get("split_cells", SPLIT_CELLS), get("first", 0), get("last", header.rows - 1))

    def writer(self, schema, overwrite: bool) -> BovWriter:
        get = self.options.__getitem__
        header = Header(int(get("rows")), int(get("columns")), int(get("band")), f"{get('name')}_%05d.bin")
        return BovWriter(get("path"), get("name"), header, float(get("time")))


def _register(spark: SparkSession) -> None:
    spark.dataSource.register(BovSource)


def write_bov(grid: DataFrame, root: str, name: str, rows: int, columns: int, time: float = 0.0, brick_cells: int = BRICK_CELLS) -> str:
    """Writes ``grid(i, j, v)`` under ``root``; the header's path.

    A task writes whole bricks one after another, under names that their places
    give, so one that runs again writes the same; the header comes last. A cell
    outside the sizes, or one that comes more than once, is an error, and then
    there is no header. Cells that the grid lacks, and null values, are a NaN of
    their own, which ``read_bov`` leaves out; other NaN values come back.
    ``root`` must be a folder that pyarrow can open and all executors share.
    """
    from pyarrow import fs

    spark, band = grid.sparkSession, max(1, brick_cells // max(1, columns))
    _register(spark)
    store, folder = fs.FileSystem.from_uri(root)
    store.create_dir(folder, recursive=True)
    cells = grid.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))
    placed = cells.repartition(F.expr(f"i div {band}")).sortWithinPartitions(F.expr(f"i div {band}"))
    options = {"name": name, "rows": rows, "columns": columns, "band": band, "time": time}
    placed.write.format("bov").mode("append").options(**options).save(root)
    return f"{root}/{name}.bov"


def read_bov(spark: SparkSession, header_path: str, first: int | None = None, last: int | None = None, split_cells: int = SPLIT_CELLS) -> DataFrame:
    """(i, j, v) of a grid from its header; cells that were not written are left out.

    ``first`` and ``last`` bound the rows, and only their bytes are read. A
    header without bricks names one data file. Only little-endian doubles are
    read. A task reads about ``split_cells`` cells of one brick, whatever the
    brick's size.
    """
    _register(spark)
    chosen = {k: v for k, v in {"split_cells": split_cells, "first": first, "last": last}.items() if v is not None}
    return spark.read.format("bov").options(**chosen).load(header_path)
