"""Python data sources for streams: appended ends of text files, and tables read over and over.

Paths are folders that pyarrow opens, by URI or on a shared mount.  Register them with ``register``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def sizes(path: str, suffix: str = "") -> dict[str, int]:
    """Bytes of each file below a folder whose name ends in ``suffix``, hidden ones aside; none where there is no folder."""
    from pyarrow import fs

    store, base = filesystem(path)
    found = store.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True))
    return {i.path: i.size for i in sorted(found, key=lambda i: i.path) if i.type == fs.FileType.File and i.path.endswith(suffix) and not i.base_name.startswith((".", "_"))}


def whole_end(store, path: str, size: int, step: int = 1 << 16) -> int:
    """Where the last line that has its newline ends, among the first ``size`` bytes."""
    with store.open_input_file(path) as f:
        end = size
        while end > 0:
            start = max(0, end - step)
            f.seek(start)
            at = f.read(end - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return 0


class Range(InputPartition):
    """Lines of a file that begin in bytes start to end; kind: "lines", or "rebuilt" for the mark of a file that shrank or went."""

    def __init__(self, path: str, start: int, end: int, kind: str) -> None:
        self.path, self.start, self.end, self.kind = path, start, end, kind


class TailReader(DataSourceStreamReader):
    """Offsets are bytes read of each file.  A range larger than ``split`` bytes is cut and read by several tasks."""

    SCHEMA = pa.schema([("file", pa.string()), ("at", pa.int64()), ("line", pa.string()), ("rebuilt", pa.bool_())])

    def __init__(self, options) -> None:
        self.path, self.suffix = options["path"], options.get("suffix", ".jsonl")
        self.split, self.last = int(options.get("split", 64 << 20)), options.get("unfinished", "false").lower() == "true"

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, _ = filesystem(self.path)
        return {p: n if self.last else whole_end(store, p, n) for p, n in sizes(self.path, self.suffix).items()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        found = [Range(p, 0, 0, "rebuilt") for p, n in start.items() if end.get(p, 0) < n]
        for p, n in end.items():
            begin = 0 if n < start.get(p, 0) else start.get(p, 0)
            found += [Range(p, a, min(n, a + self.split), "lines") for a in range(begin, n, self.split)]
        return found or [Range("", 0, 0, "lines")]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.kind == "rebuilt":
            yield pa.RecordBatch.from_pylist([{"file": part.path, "at": 0, "line": None, "rebuilt": True}], self.SCHEMA)
            return
        if part.start >= part.end:
            return
        store, _ = filesystem(self.path)
        with store.open_input_file(part.path) as f:
            # a line belongs to the range where it begins: the byte before tells whether one begins at the start
            at = part.start
            if at:
                f.seek(at - 1)
                at += len(self._line(f)) - 1
            f.seek(at)
            rows: list[tuple[int, bytes]] = []
            while at < part.end:
                line = self._line(f)
                if not line:
                    break
                rows.append((at, line.rstrip(b"\r\n")))
                at += len(line)
                if len(rows) >= 10_000:
                    yield self._batch(part.path, rows)
                    rows = []
            if rows:
                yield self._batch(part.path, rows)

    @staticmethod
    def _line(f, step: int = 1 << 16) -> bytes:
        """The next line with its newline, wherever it ends."""
        begin, parts = f.tell(), []
        while piece := f.read(step):
            cut = piece.find(b"\n")
            if cut >= 0:
                parts.append(piece[: cut + 1])
                break
            parts.append(piece)
        line = b"".join(parts)
        f.seek(begin + len(line))
        return line

    def _batch(self, path: str, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array([a for a, _ in rows], pa.int64()), pa.array([x.decode("utf-8", "replace") for _, x in rows]), pa.array([False] * len(rows))], schema=self.SCHEMA)


class Tail(DataSource):
    """file, at (byte), line, rebuilt: lines appended below ``path`` since the last batch.

    Spark's own file source reads a file once; this one reads what known files have gained.  A line
    counts once its newline is there (``unfinished``: at once).  A file that is shorter than what was
    read of it is read from its beginning, after a row with ``rebuilt`` and no line; so is a row for a
    file that went.  One that shrank and grew past its old length between two batches looks like an
    appended one.  Bytes that aren't UTF-8 become replacement characters.
    """

    @classmethod
    def name(cls) -> str:
        return "loom_tail"

    def schema(self) -> str:
        return "file string, at long, line string, rebuilt boolean"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


class Unit(InputPartition):
    def __init__(self, epoch: int, place: int, path: str, group: int) -> None:
        self.epoch, self.place, self.path, self.group = epoch, place, path, group


class CycleReader(DataSourceStreamReader):
    """The offset is a place on the endless line of units: epoch * units + unit; a unit is one row group of a Parquet file.

    Files are taken in the order of their paths and must not change.  A batch takes ``units`` of them
    and stops at the end of the last epoch.  How far batches were planned is kept in ``progress``, for
    Spark asks a restarted reader for its latest offset before it tells where the query stands.
    """

    def __init__(self, options, schema) -> None:
        self.path, self.progress, self.names = options["path"], options.get("progress"), [f.name for f in schema.fields if f.name not in ("epoch", "place", "row")]
        self.epochs, self.step = int(options.get("epochs", 0)), int(options.get("units", 0))
        if not self.epochs and not (self.step and self.progress):
            raise ValueError("an endless cycle needs the options units and progress")
        self.planned, self.found = 0, None

    def _units(self) -> list[tuple[str, int]]:
        import pyarrow.parquet as pq

        if self.found is None:
            store, _ = filesystem(self.path)
            self.found = [(p, g) for p in sizes(self.path, ".parquet") for g in range(pq.read_metadata(p, filesystem=store).num_row_groups)]
        return self.found

    def _kept(self) -> int:
        if not self.progress:
            return 0
        store, path = filesystem(self.progress)
        try:
            with store.open_input_file(path) as f:
                return json.loads(f.read())["at"]
        except FileNotFoundError:
            return 0

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        whole = self.epochs * len(self._units())
        if not self.step:
            return {"at": whole}
        self.planned = max(self.planned, self._kept()) + self.step * bool(self._units())
        self.planned = min(self.planned, whole) if self.epochs else self.planned
        return {"at": self.planned}

    def partitions(self, start: dict, end: dict) -> list[Unit]:
        if self.progress and end["at"] > self._kept():
            store, path = filesystem(self.progress)
            with store.open_output_stream(path) as f:
                f.write(json.dumps(end).encode())
        units = self._units()
        return [Unit(at // len(units), at % len(units), *units[at % len(units)]) for at in range(start["at"], end["at"])] or [Unit(0, 0, "", 0)]

    def read(self, unit: Unit) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        if not unit.path:
            return
        store, _ = filesystem(self.path)
        file, row = pq.ParquetFile(unit.path, filesystem=store), 0
        for batch in file.iter_batches(10_000, row_groups=[unit.group], columns=self.names):
            n = batch.num_rows
            head = [pa.array([unit.epoch] * n, pa.int32()), pa.array([unit.place] * n, pa.int32()), pa.array(range(row, row + n), pa.int64())]
            yield pa.RecordBatch.from_arrays([*head, *[batch[c] for c in self.names]], ["epoch", "place", "row", *self.names])
            row += n


class Cycle(DataSource):
    """epoch, place, row and the columns of the option ``columns`` (a schema text): Parquet files read ``epochs`` times (0: without end).

    Rows of an epoch are ordered by (place, row), the same in each.
    """

    @classmethod
    def name(cls) -> str:
        return "loom_cycle"

    def schema(self) -> str:
        return "epoch int, place int, row long, " + self.options["columns"]

    def streamReader(self, schema) -> CycleReader:
        return CycleReader(self.options, schema)


def register(spark: SparkSession) -> None:
    for source in (Tail, Cycle):
        spark.dataSource.register(source)
