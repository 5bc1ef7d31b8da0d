"""Tables of segments on shared storage, with atomic versions.

A table is dealt into buckets by a hash of its key. A commit writes one *segment* for each bucket that its rows fall in: only
these rows, each whole, in order of the key. Of several rows with one key the one of the latest version counts; a row that is
``_gone`` removes its key. So a commit costs what it changes, not what is stored. Segments of a bucket are merged when enough of
similar size have gathered at the end of its list, so a row is rewritten a number of times that grows with the logarithm
of the table.

A version is one small file that names every segment. It is created without overwriting: of two writers that prepare the same
version one succeeds, and the other starts again from what is stored then. Readers keep the version that they began with.

A version also holds tokens ``{query: batch}``: the last batch of each streaming query whose rows are in. A batch that comes
again after a failure is known by its token.
"""

from __future__ import annotations

import copy
import json
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

FANOUT = 4
SPLITS = 4  # files of a bucket in one segment, at most: a bucket is no single task
FEW_KEYS = 1000  # so many keys are looked up by value, which prunes row groups; more are joined


class Folder:
    """Small files in a folder of any file system that Spark reaches, from the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.path, self.conf = path.rstrip("/"), spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.at("").getFileSystem(self.conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        top = self.at(name)
        return [f.getPath().getName() for f in self.fs.listStatus(top)] if self.fs.exists(top) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a whole file unless there is one of that name: true for exactly one of any number of writers."""
        draft = self.at(f"_draft-{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        target = self.at(name)
        try:
            self.fs.mkdirs(target.getParent())
            local = self.fs.getUri().getScheme() == "file"
            self._link(draft, target) if local else self._rename(draft, target)
            return True
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName() or "AlreadyExists" in str(e.java_exception):
                return False
            raise
        finally:
            self.fs.delete(draft, False)

    def _link(self, draft, target) -> None:
        file = lambda p: self.jvm.java.io.File(p.toUri().getPath()).toPath()
        self.jvm.java.nio.file.Files.createLink(file(target), file(draft))

    def _rename(self, draft, target) -> None:
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.gateway.new_array(rename, 1)
        how[0] = rename.NONE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        context.rename(draft, target, how)

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self.at(name)).getLength()

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


@dataclass
class State:
    """One version: for each table and bucket its segments ``[name, bytes, latest time]``, oldest first."""

    number: int = 0
    buckets: int = 64
    tables: dict[str, dict[str, list[list]]] = field(default_factory=dict)
    tokens: dict[str, int] = field(default_factory=dict)

    def next(self) -> State:
        out = copy.deepcopy(self)
        out.number += 1
        return out

    def of(self, table: str) -> dict[str, list[list]]:
        return self.tables.setdefault(table, {})


def due(sizes: Sequence[int], fanout: int = FANOUT) -> int | None:
    """Where the run of segments begins that should be merged: the longest end of the list in which none is ``fanout`` times
    larger than all after it together, if it has ``fanout`` members."""
    total, at = 0, len(sizes)
    while at > 0 and (total == 0 or sizes[at - 1] <= fanout * total):
        at -= 1
        total += max(1, sizes[at])
    return at if len(sizes) - at >= fanout else None


class Segments:
    def __init__(self, spark: SparkSession, path: str, keys: dict[str, list[str]], times: dict[str, str], buckets: int = 64, fanout: int = FANOUT):
        """``keys``: each table's key, whose first column deals its rows into buckets. ``times``: the time of a row, if it has one."""
        self.spark, self.path, self.keys, self.times, self.buckets, self.fanout = spark, path.rstrip("/"), keys, times, buckets, fanout
        self.folder = Folder(spark, self.path)

    # versions

    def versions(self) -> list[int]:
        return sorted(int(n[2:-5]) for n in self.folder.names("_versions") if n.startswith("v=") and n.endswith(".json"))

    def current(self) -> State:
        found = self.versions()
        return State(**json.loads(self.folder.read(f"_versions/v={found[-1]:012}.json"))) if found else State(buckets=self.buckets)

    def commit(self, state: State) -> bool:
        return self.folder.create(f"_versions/v={state.number:012}.json", json.dumps(state.__dict__))

    # rows

    def bucket(self, table: str, state: State):
        return F.pmod(F.xxhash64(self.keys[table][0]), F.lit(state.buckets)).cast("int")

    def places(self, table: str, keys: DataFrame, state: State) -> tuple[set[str], list | None]:
        """The buckets that keys fall in, and the values of their first column if they are few."""
        each = keys.select(self.bucket(table, state).cast("string").alias("b"), F.col(keys.columns[0]).alias("k"))
        some = each.limit(4 * FEW_KEYS + 1).collect()  # no distinct keys are looked for among many rows, which costs a shuffle
        few = {r.k: r.b for r in some}
        if len(some) <= 4 * FEW_KEYS and len(few) <= FEW_KEYS:
            return set(few.values()), list(few)
        return {r.b for r in each.select("b").distinct().collect()}, None

    @staticmethod
    def _schema(schema: StructType) -> StructType:
        return StructType([*schema.fields, StructField("_version", LongType()), StructField("_gone", BooleanType())])

    def raw(self, table: str, schema: StructType, state: State, buckets: Iterable[str] | None = None, lone: bool | None = None) -> DataFrame:
        """All rows of segments, also those that later ones replace; ``lone``: only buckets with one segment, or with more."""
        kept = [(b, s) for b, s in state.of(table).items() if (buckets is None or b in buckets) and (lone is None or lone == (len(s) == 1))]
        paths = [f"{self.path}/{table}/{seg[0]}/bucket={b}" for b, s in kept for seg in s]
        full = self._schema(schema)
        return self.spark.read.schema(full).parquet(*paths) if paths else self.spark.createDataFrame([], full)

    def read(self, table: str, schema: StructType, state: State, only: DataFrame | None = None) -> DataFrame:
        """The rows that count. ``only``: keys (columns that the table's key begins with) that are asked for; only their buckets are
        read, and of these, if the keys are few, only the row groups that may hold them."""
        buckets, few = (None, None) if only is None or not state.of(table) else self.places(table, only, state)

        def asked(df: DataFrame) -> DataFrame:
            if few is not None:
                df = df.filter(F.col(only.columns[0]).isin(few))
            return df if only is None else df.join(only, list(only.columns), "left_semi").select(*df.columns)

        one, more = (asked(self.raw(table, schema, state, buckets, lone)) for lone in (True, False))
        latest = more.groupBy(*self.keys[table]).agg(F.max_by(F.struct(*more.columns), "_version").alias("_row")).select("_row.*")
        return one.unionByName(latest).filter(~F.col("_gone")).select(*schema.names)

    def append(self, table: str, df: DataFrame, state: State, gone: DataFrame | None = None) -> None:
        """Rows, and keys to remove, as one segment of the version that is prepared in ``state``."""
        rows = df.withColumn("_gone", F.lit(False))
        if gone is not None:
            rows = rows.unionByName(gone.select(*self.keys[table]).withColumn("_gone", F.lit(True)), allowMissingColumns=True)
        self._write(table, rows.withColumn("_version", F.lit(state.number).cast("long")), state, f"seg={state.number:012}-{uuid.uuid4().hex[:8]}", lambda held, new: [*held, new])

    def _write(self, table: str, rows: DataFrame, state: State, name: str, place: Callable[[list, list], list]) -> None:
        key = self.keys[table]
        out = rows.withColumn("bucket", self.bucket(table, state))
        split = F.pmod(F.xxhash64(*key, F.lit(1)), F.lit(SPLITS))
        out.repartition("bucket", split).sortWithinPartitions("bucket", *key).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{table}/{name}")
        written = [n.removeprefix("bucket=") for n in self.folder.names(f"{table}/{name}") if n.startswith("bucket=")]
        latest: dict = {}
        if table in self.times and written:
            back = self.spark.read.schema(StructType([StructField(self.times[table], LongType())])).parquet(*(f"{self.path}/{table}/{name}/bucket={b}" for b in written))
            at = F.regexp_extract(F.input_file_name(), r"/bucket=(\d+)/", 1)
            latest = {r[0]: r[1] for r in back.groupBy(at).agg(F.max(self.times[table])).collect()}
        for b in written:
            held = state.of(table).get(b, [])
            state.of(table)[b] = place(held, [name, self.folder.size(f"{table}/{name}/bucket={b}"), latest.get(b)])

    def drop_before(self, table: str, time: int, state: State) -> dict[str, list[str]]:
        """Forget the oldest segments of buckets whose rows all lie before a time, unread; the names dropped, by bucket."""
        dropped: dict[str, list[str]] = {}
        for b, held in list(state.of(table).items()):
            n = 0
            while n < len(held) and held[n][2] is not None and held[n][2] < time:
                n += 1
            if n:
                dropped[b] = [s[0] for s in held[:n]]
                state.of(table)[b] = held[n:]
                if not state.of(table)[b]:
                    del state.of(table)[b]
        return dropped

    def compact(self, schemas: dict[str, StructType], whole: bool = False) -> int:
        """Merge runs of segments that are due, or (``whole``) all segments of each bucket; the number of buckets merged."""
        for _ in range(20):
            before = self.current()
            state, n = before.next(), 0
            for table, schema in schemas.items():
                runs: dict[str, int] = {}
                for b, held in before.of(table).items():
                    at = (0 if len(held) > 1 else None) if whole else due([s[1] for s in held], self.fanout)
                    if at is not None:
                        runs[b] = at
                if not runs:
                    continue
                n += len(runs)
                # a removed key must stay removed while older segments may hold it
                for bottom in (True, False):
                    some = {b: at for b, at in runs.items() if (at == 0) == bottom}
                    if not some:
                        continue
                    part = State(before.number, before.buckets, {table: {b: before.of(table)[b][at:] for b, at in some.items()}})
                    rows = self.raw(table, schema, part)
                    latest = rows.groupBy(*self.keys[table]).agg(F.max_by(F.struct(*rows.columns), "_version").alias("_row")).select("_row.*")
                    latest = latest.filter(~F.col("_gone")) if bottom else latest
                    for b, at in some.items():
                        state.of(table)[b] = state.of(table)[b][:at]
                        if not state.of(table)[b]:
                            del state.of(table)[b]
                    self._write(table, latest, state, f"merged={state.number:012}-{uuid.uuid4().hex[:8]}", lambda held, new: [*held, new])
            if not n or self.commit(state):
                return n
        raise RuntimeError("other writers came first in 20 attempts to merge segments")

    def vacuum(self) -> None:
        """Remove segments and versions that the last version does not name. No reader of an older version may be left, and no
        writer at work."""
        state = self.current()
        for table in self.keys:
            used = {s[0] for held in state.of(table).values() for s in held}
            for n in self.folder.names(table):
                if n not in used:
                    self.folder.delete(f"{table}/{n}")
        for v in self.versions():
            if v != state.number:
                self.folder.delete(f"_versions/v={v:012}.json")
