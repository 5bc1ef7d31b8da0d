"""Captured files of frames (a varint length and that many bytes each), read by many tasks.

A file has no index, so a task that begins in its middle has to find where a frame starts: it takes the first place from which
lengths lead on from frame to frame, each of them a JSON object, a few times over. That can go wrong, next to a broken record
or where a record quotes frames. So each split also says where it came out, and the split after it must have begun there. A second
pass goes through these numbers in order and walks a split that did not again from the right place; as the first split begins
at the file's beginning, the frames are then those that one reader from the front would give.

Frames are returned whole and numbered through the file, also those that are no records. ``truncated`` says that the file
ends inside a frame. Nothing is held but one frame, a window of the file and a batch of rows.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import staging

SPLIT_BYTES = 64 << 20
CHAIN = 4  # frames in a row that must be records
VARINT = 10


def varint(data: bytes, at: int) -> tuple[int, int] | None:
    """The number at a place and where it ends; None if the data ends in it or it is none."""
    size = shift = 0
    while at < len(data) and shift < 7 * VARINT:
        byte = data[at]
        size |= (byte & 0x7F) << shift
        shift += 7
        at += 1
        if not byte & 0x80:
            return size, at
    return None


class FrameFile:
    """A file that is read forward, with a few steps back."""

    def __init__(self, path: str, window: int = 1 << 20):
        import pyarrow.fs

        fs, own = pyarrow.fs.FileSystem.from_uri(path) if ":" in path else (pyarrow.fs.LocalFileSystem(), path)
        self.size = fs.get_file_info(own).size
        self.file = io.BufferedReader(_Raw(fs.open_input_file(own)), max(1 << 12, min(window, 1 << 20)))

    def frame(self, at: int, body: bool = True) -> tuple[int, bytes | None] | None:
        """The place after the frame at ``at``, and its bytes; None if the file ends in it."""
        self.file.seek(at)
        head = varint(self.file.read(VARINT), 0)
        if head is None or at + head[1] + head[0] > self.size:
            return None
        self.file.seek(at + head[1])
        return at + head[1] + head[0], self.file.read(head[0]) if body else None

    def begins(self, at: int) -> bool:
        """Whether a few frames that follow each other from here are records."""
        for _ in range(CHAIN):
            if at == self.size:
                return True
            got = self.frame(at)
            if got is None or not _record(got[1]):
                return False
            at = got[0]
        return True

    def first(self, start: int, end: int) -> int:
        """The first place of a frame in a part of the file, as it seems; the end if there is none."""
        if start == 0:
            return 0
        for at in range(start, min(end, self.size)):
            self.file.seek(at)
            head = self.file.read(VARINT + 1)
            n = varint(head, 0)
            if n and n[0] > 1 and n[1] < len(head) and head[n[1]] in b"{ \t\r\n" and self.begins(at):
                return at
        return end


class _Raw(io.RawIOBase):
    def __init__(self, file):
        self.inner = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, at: int, whence: int = 0) -> int:
        self.inner.seek(at, whence)
        return self.inner.tell()

    def tell(self) -> int:
        return self.inner.tell()

    def readinto(self, into) -> int:
        got = self.inner.read(len(into))
        into[: len(got)] = got
        return len(got)


def _record(body: bytes) -> bool:
    try:
        return body.lstrip()[:1] == b"{" and isinstance(json.loads(body), dict)
    except ValueError:
        return False


_SPLIT = "file string, split bigint, start bigint, stop bigint"
_WALKED = f"{_SPLIT}, first bigint, out bigint, n bigint, truncated boolean"
_PLACED = f"{_WALKED}, base bigint"
_FRAME = "file string, position bigint, offset bigint, body binary, truncated boolean"


def _steps(f: FrameFile, first: int, stop: int) -> tuple[int, int, bool]:
    """From a frame's beginning: where the first frame after a split begins, how many begin in it, and whether the file ends in one."""
    at, n = first, 0
    while at < min(stop, f.size):
        got = f.frame(at, body=False)
        if got is None:
            return f.size, n, True
        at, n = got[0], n + 1
    return at, n, False


def _table(rows: list[tuple], ddl: str):
    import pyarrow as pa

    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split() for f in ddl.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], [n for n, _ in fields])


def _walk(splits: DataFrame) -> DataFrame:
    """For each split where its first frame seems to begin (``first``), and what a walk from there finds."""

    def walk(batches: Iterator) -> Iterator:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                f = FrameFile(r["file"], r["stop"] - r["start"])
                first = f.first(r["start"], r["stop"])
                rows.append((*(r[c] for c in ("file", "split", "start", "stop")), first, *_steps(f, first, r["stop"])))
            yield _table(rows, _WALKED)

    return splits.mapInArrow(walk, _WALKED)


def _placed(walked: DataFrame, tasks: int) -> DataFrame:
    """The splits of each file in order: one that did not begin where the last came out is walked again from there, at once, so
    that a wrong guess costs its own split and misleads none behind it. ``base``: the frames before a split."""

    def place(batches: Iterator) -> Iterator:
        file, out, base = None, 0, 0
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if r["file"] != file:
                    file, out, base = r["file"], 0, 0
                if out >= r["stop"]:  # a frame of an earlier split covers it whole
                    first, n, cut = out, 0, False
                elif r["first"] == out:
                    first, out, n, cut = out, r["out"], r["n"], r["truncated"]
                else:
                    first = out
                    out, n, cut = _steps(FrameFile(file, r["stop"] - r["start"]), first, r["stop"])
                rows.append((file, r["split"], r["start"], r["stop"], first, out, n, cut, base))
                base += n
            yield _table(rows, _PLACED)

    return walked.repartition(tasks, "file").sortWithinPartitions("file", "split").mapInArrow(place, _PLACED)


def read_frames(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``(file, position, offset, body, truncated)``, a row for each frame, and one with position -1 for a file without any
    whole one. A file without bytes gives no row. A task reads many splits where they are small."""
    import uuid

    names = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("size"))
    splits = names.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"), "size")
    splits = splits.select("file", F.expr(f"start div {split_bytes}").alias("split"), "start", F.least(F.col("start") + split_bytes, "size").alias("stop"))
    top = f"{staging.shared_dir(spark)}/keyloom/frames-{uuid.uuid4().hex}"

    def put(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{top}/{name}")
        return spark.read.schema(df.schema).parquet(f"{top}/{name}")

    parts, size = splits.agg(F.count("*"), F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0))).first()
    tasks = max(1, min(parts, max(2 * spark.sparkContext.defaultParallelism, -(-size // SPLIT_BYTES))))
    placed = put(_placed(put(_walk(splits.repartition(tasks, "file", "split")), "walked"), tasks), "placed")
    whole = placed.groupBy("file").agg(F.max("truncated").alias("cut"), F.sum("n").alias("total"))
    known = placed.drop("truncated").join(whole, "file")

    def read(batches: Iterator) -> Iterator:
        for b in batches:
            for r in b.to_pylist():
                rows, size = [], 0
                if not r["total"] and r["split"] == 0:
                    rows.append((r["file"], -1, 0, None, r["cut"]))
                f, at = FrameFile(r["file"], r["stop"] - r["start"]) if r["n"] else None, r["first"]
                for k in range(r["n"]):
                    after, body = f.frame(at)
                    rows.append((r["file"], r["base"] + k, at, body, r["cut"]))
                    at, size = after, size + len(body)
                    if len(rows) >= 2000 or size > 8 << 20:
                        yield _table(rows, _FRAME)
                        rows, size = [], 0
                yield _table(rows, _FRAME)

    return known.repartition(tasks, "file", "split").mapInArrow(read, _FRAME)


def write_frames(records: DataFrame, path: str, body: str = "body") -> None:
    """The records of a column (bytes) as captured files, one for each task; null ones are left out. The folder is on a file system
    that all workers mount, and each file appears whole."""
    folder = staging.mounted(path)

    def write(batches: Iterator) -> Iterator:
        import os
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        from .ingest import frame

        os.makedirs(folder, exist_ok=True)
        draft, n = os.path.join(folder, f".{uuid.uuid4().hex}"), 0
        with open(draft, "wb") as f:
            for b in batches:
                for x in b.column(0).to_pylist():
                    if x is not None:
                        f.write(frame(x))
                        n += 1
        os.replace(draft, os.path.join(folder, f"part-{TaskContext.get().partitionId():06}"))  # a retried task replaces its own
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    records.select(body).mapInArrow(write, "n bigint").collect()
