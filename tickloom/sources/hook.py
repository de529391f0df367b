"""Output hooks per day and slice, as a Python data source writer.

Each task hands its rows, slice by slice, to the hook, which stages them and says what it staged. What all
tasks staged becomes visible in one step at the end of the job; a task or job that fails takes
its own staged output away again, so a retry never leaves anything twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

HOOK_FORMAT = "tickloom_slice_hook"


class SliceHook:
    """What a caller does with the rows of one (day, slice); all methods but ``publish`` run in tasks."""

    def stage(self, day: object, end_time: str, rows: Iterator[pa.RecordBatch]) -> str:
        """Write ``rows`` where nobody reads yet; the return value names what was written."""
        raise NotImplementedError

    def publish(self, staged: list[str]) -> None:
        """Make all of it visible; called once, on the driver."""
        raise NotImplementedError

    def discard(self, staged: list[str]) -> None:
        """Take it away."""
        raise NotImplementedError


@dataclass
class ParquetHook(SliceHook):
    """One parquet file per (day, slice) and task below ``root``: ``end_time=<slice>/<day>-<id>.parquet``."""

    root: str

    def _place(self, path: str) -> tuple[fs.FileSystem, str]:
        # A plain path and one with a scheme both name the shared folder.
        return fs.FileSystem.from_uri(f"{self.root}/{path}") if "://" in self.root or self.root.startswith(("file:", "/")) else (
            fs.LocalFileSystem(), f"{self.root}/{path}")

    def stage(self, day, end_time, rows):
        name = self._name(day, end_time)
        files, path = self._place(f"_staged/{name}")
        files.create_dir(path.rpartition("/")[0])
        first = next(rows)
        with files.open_output_stream(path) as out, pq.ParquetWriter(out, first.schema) as writer:
            writer.write_batch(first)
            for batch in rows:
                writer.write_batch(batch)
        return name

    def _name(self, day: object, end_time: str) -> str:
        return f"end_time={end_time}/{day}-{uuid.uuid4().hex}.parquet"

    def publish(self, staged):
        for name in staged:
            files, path = self._place(name)
            files.create_dir(path.rpartition("/")[0])
            files.move(self._place(f"_staged/{name}")[1], path)

    def discard(self, staged):
        for name in staged:
            files, path = self._place(f"_staged/{name}")
            if files.get_file_info(path).type != fs.FileType.NotFound:
                files.delete_file(path)


@dataclass
class NamedFilesHook(ParquetHook):
    """Result files under the names their readers look for: ``<yyyymmdd><slice>.parquet``, the slice being
    empty for a day's merged file or a suffix such as ``_s2_p1`` for a part of a shard."""

    def _name(self, day, end_time):
        return f"{day:%Y%m%d}{end_time}.parquet"


@dataclass
class _Staged(WriterCommitMessage):
    names: list[str]


class _HookWriter(DataSourceArrowWriter):
    def __init__(self, hook: SliceHook):
        self.hook = hook

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        names: list[str] = []
        try:
            for day, end_time, rows in _slices(iterator):
                names.append(self.hook.stage(day, end_time, rows))
        except BaseException:
            self.hook.discard(names)
            raise
        return _Staged(names)

    def commit(self, messages) -> None:
        self.hook.publish([n for m in messages if m is not None for n in m.names])

    def abort(self, messages) -> None:
        self.hook.discard([n for m in messages if m is not None for n in m.names])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str, Iterator[pa.RecordBatch]]]:
    """(day, slice, batches) of rows sorted by day and slice."""
    from itertools import groupby

    def cut():
        for batch in batches:
            keys = list(zip(batch.column("trade_date").to_pylist(), batch.column("end_time").to_pylist()))
            lo = 0
            for key, own in groupby(keys):
                n = sum(1 for _ in own)
                yield key, batch.slice(lo, n)
                lo += n

    for (day, end_time), own in groupby(cut(), key=lambda piece: piece[0]):
        yield day, end_time, (batch for _, batch in own)


def hook_source(hook: SliceHook) -> type[DataSource]:
    """A data source whose writer calls ``hook``."""
    class HookSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return HOOK_FORMAT

        def schema(self):
            raise NotImplementedError("this source only writes")

        def writer(self, schema, overwrite):
            return _HookWriter(hook)

    return HookSource
