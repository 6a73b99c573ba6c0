"""A data source of analyzer records: JSON lines in files that grow, read as a batch or as a stream.

    spark.dataSource.register(RecordSource)
    spark.read.format("analyzer_records").load(folder)
    spark.readStream.format("analyzer_records").load(folder)

Every whole line is a row: the record's fields, the file, the offset of the line in bytes, and why it is rejected (null: accepted). A line
of more than `max_bytes` bytes, or one that is no JSON object in UTF-8, is rejected and the next is read; a line without its end is not
there yet. A stream's position is the end of the last whole line of each file, so a restart reads nothing twice and what is
appended is read from where the last batch ended. Files are cut into ranges of about `range_bytes`, each a task; a line
belongs to the range that it begins in. The position holds an entry per file, so folders should be rolled before they hold millions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "record_type string, source_name string, source_version string, analyzed_at string, data string, file string, offset long, reason string, line string"
MAX_BYTES, RANGE_BYTES, STEP = 1 << 20, 64 << 20, 1 << 20
_TEXTS = ("record_type", "source_name", "source_version", "analyzed_at")


def _files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if ":" in folder.partition("/")[0] else "file://" + folder)


@dataclass(frozen=True)
class Range(InputPartition):
    """Lines of a file that begin in [start, end); limit: where the last whole line ends."""

    path: str
    start: int
    end: int
    limit: int


def _listed(folder: str) -> dict[str, int]:
    """Files of a folder, with their sizes; those whose names begin with . or _ are hidden."""
    from pyarrow import fs

    system, path = _files(folder)
    found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return {f.path: f.size for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))}


def _last_line_end(folder: str, path: str, size: int, known: int = 0) -> int:
    """The place after the last line end of a file, at known or after it."""
    system, _ = _files(folder)
    with system.open_input_file(path) as f:
        to = size
        while to > known:
            at = max(known, to - STEP)
            place = f.read_at(to - at, at).rfind(b"\n")
            if place >= 0:
                return at + place + 1
            to = at
    return known


def _lines(folder: str, r: Range, max_bytes: int) -> Iterator[tuple[int, bytes | None]]:
    """(offset, line, or None for one that is too long) of a range."""
    system, _ = _files(folder)
    with system.open_input_file(r.path) as f:
        at, held, start, long = r.start, b"", r.start, False
        skip = r.start > 0 and f.read_at(1, r.start - 1) != b"\n"  # a line that the range before has
        while at < r.limit and (start < r.end or skip):
            block = f.read_at(min(STEP, r.limit - at), at)
            at += len(block)
            pieces = block.split(b"\n")
            for i, piece in enumerate(pieces):
                held = b"" if long or skip else held + piece
                long = long or len(held) > max_bytes
                if i == len(pieces) - 1:
                    continue  # the line goes on in the next block
                here = at - len(b"\n".join(pieces[i + 1 :]))
                if not skip and start < r.end:
                    yield start, None if long else held
                skip, long, held, start = False, False, b"", here
                if start >= r.end:
                    return


def _row(folder: str, r: Range, max_bytes: int):
    for offset, line in _lines(folder, r, max_bytes):
        reason, fields, text = None, {}, None
        if line is None:
            reason = "too long"
        elif not line.strip():
            continue
        else:
            try:
                text = line.decode().rstrip("\r")
                fields = json.loads(text)
                if not isinstance(fields, dict):
                    fields, reason = {}, "no object"
            except UnicodeDecodeError:
                reason = "no UTF-8"
            except (ValueError, RecursionError):
                reason = "no JSON"
        values = [fields[c] if isinstance(fields.get(c), str) else None for c in _TEXTS]
        data = fields.get("data")
        yield (*values, None if data is None else json.dumps(data, ensure_ascii=False, separators=(",", ":")), r.path, offset, reason, text if reason else None)


class _Reader:
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.max_bytes, self.range_bytes = int(options.get("max_bytes", MAX_BYTES)), int(options.get("range_bytes", RANGE_BYTES))

    def ranges(self, before: dict[str, int], after: dict[str, int]) -> list[Range]:
        out = []
        for path, end in sorted(after.items()):
            start = before.get(path, 0)
            out += [Range(path, lo, min(end, lo + self.range_bytes), end) for lo in range(start, end, self.range_bytes)]
        return out

    def ends(self, known: dict[str, int]) -> dict[str, int]:
        """Where the last whole line of each file ends; a file that has shrunk or gone keeps its place."""
        found = {p: _last_line_end(self.folder, p, size, known.get(p, 0)) if size > known.get(p, 0) else known.get(p, 0) for p, size in _listed(self.folder).items()}
        return known | found


class _Batch(_Reader, DataSourceReader):
    def partitions(self):
        return self.ranges({}, self.ends({})) or [Range("", 0, 0, 0)]

    def read(self, partition):
        return _row(self.folder, partition, self.max_bytes) if partition.path else iter(())


class _Stream(_Reader, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        self.known = self.ends(self.known)
        return {"files": self.known}

    def partitions(self, start: dict, end: dict):
        return self.ranges(start["files"], end["files"])

    def read(self, partition):
        return _row(self.folder, partition, self.max_bytes)


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "analyzer_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))
