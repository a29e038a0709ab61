"""An indexed, append-only table of Parquet snapshots.

A row carries `{prefix}: struct<index, timestamp>`; indexes are dense and grow in append order. Files of a commit are
sorted by index and partitioned by `part = index div PART_ROWS`, so a page or point lookup prunes folders and row groups.
Commits are written beside the data and take effect by one rename of a manifest, so readers always see a whole snapshot;
compaction writes new files, swaps the manifest, and keeps the old files until they are retired, which passes over what a
pinned reader still needs.

Single rows may be ``put``: they wait in the writer's memory, ``capacity`` at most, and are seen by its own scans before they
are committed.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.storage import cut, fresh

PART_ROWS = 1_000_000


class NotFound(KeyError):
    """No row has that index."""


def meta(prefix: str) -> str:
    return f"{prefix}_meta" if not prefix.endswith("_meta") else prefix


def with_index(df: DataFrame, order: list[Column | str], start: int = 0, column: str = "index") -> DataFrame:
    """Dense indexes from ``start`` in the given order, without a one-task window over rows: range partitions are written with
    each row's place in them, and a table of their offsets, one row for each, is broadcast to them."""
    part, at, base = (fresh(df.columns, f"__{x}") for x in ("part", "at", "base"))
    row = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = cut(ranged.withColumns({part: F.shiftright(row, 33).cast("int"), at: row.bitwiseAND(F.lit((1 << 33) - 1))}))
    before = F.sum("count").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    offsets = ranged.groupBy(part).count().select(part, (F.coalesce(before, F.lit(0)) + start).alias(base))
    return ranged.join(F.broadcast(offsets), part).withColumn(column, F.col(base) + F.col(at)).drop(part, at, base)


class Table:
    """``path`` may be in any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, prefix: str = "_output_meta", capacity: int = 1000):
        self.spark, self.path, self.prefix, self.capacity, self.hot = spark, path.rstrip("/"), prefix, capacity, []
        kind = T.StructType([T.StructField("index", T.LongType()), T.StructField("timestamp", T.TimestampType())])
        self.schema = T.StructType([*(f for f in schema if f.name != prefix), T.StructField(prefix, kind)])
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _manifest(self) -> dict:
        if not self._fs.exists(self._p("_manifests")):
            return {"version": 0, "commits": [], "next": 0, "rows": 0}
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._p("_manifests")) if s.getPath().getName().endswith(".json"))
        if not names:
            return {"version": 0, "commits": [], "next": 0, "rows": 0}
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/_manifests/{names[-1]}", wholetext=True).collect()))

    def _commit(self, m: dict) -> None:
        """Atomic: a rename to the next version's name fails if another writer has it."""
        m = m | {"version": m["version"] + 1}
        held, name = self._p(f"_manifests/.{uuid.uuid4().hex}"), self._p(f"_manifests/{m['version']:012d}.json")
        out = self._fs.create(held)
        out.write(json.dumps(m).encode())
        out.close()
        if self._fs.exists(name) or not self._fs.rename(held, name):
            raise RuntimeError("another writer has committed; append again")

    def _write(self, rows: DataFrame) -> str:
        name = f"commits/__commit={uuid.uuid4().hex}"
        index = F.col(f"{self.prefix}.index")
        placed = rows.withColumn("__part", F.expr(f"{self.prefix}.index div {PART_ROWS}"))
        placed.sortWithinPartitions("__part", index).write.partitionBy("__part").parquet(f"{self.path}/{name}")
        return name

    def put(self, row: dict) -> int:
        """One row, which waits in memory until ``capacity`` rows do; its index."""
        self.hot.append(row)
        index = self._manifest()["next"] + len(self.hot) - 1
        if len(self.hot) >= self.capacity:
            self.flush()
        return index

    def flush(self) -> None:
        """Commits the rows that wait."""
        waiting, self.hot = self.hot, []
        if waiting:
            self.append(self._frame(waiting).coalesce(1))

    def _frame(self, rows: list[dict]) -> DataFrame:
        kind = T.StructType([f for f in self.schema if f.name != self.prefix])
        return self.spark.createDataFrame([tuple(r.get(f.name) for f in kind) for r in rows], kind)

    def _waiting(self, m: dict) -> DataFrame:
        stamp = F.struct((F.col("__i") + m["next"]).cast("long").alias("index"), F.current_timestamp().alias("timestamp"))
        kind = T.StructType([*(f for f in self.schema if f.name != self.prefix), T.StructField("__i", T.LongType())])
        rows = [(*(r.get(f.name) for f in kind[:-1]), i) for i, r in enumerate(self.hot)]
        return self.spark.createDataFrame(rows, kind).withColumn(self.prefix, stamp).drop("__i")

    def append(self, df: DataFrame, order: list[Column | str] | None = None, index: str | None = None) -> None:
        """Adds rows; indexes continue in ``order`` (else in the frame's order), or are taken from the column ``index``."""
        if self.hot and index is None:
            self.flush()
        m = self._manifest()
        if index is None:
            kept = df.select("*") if order else df.withColumn("__seq", F.monotonically_increasing_id())
            df, index = with_index(kept, order or ["__seq"], m["next"], "__index"), "__index"
        stamped = df.withColumn(self.prefix, F.struct(F.col(index).cast("long").alias("index"), F.current_timestamp().alias("timestamp")))
        rows = stamped.select(*((F.col(f"`{f.name}`") if f.name in stamped.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema))
        name = self._write(rows)
        written = self._parts({"commits": [name]}).agg(F.count("*"), F.max(f"{self.prefix}.index")).first()
        if written[0]:
            self._commit(m | {"commits": [*m["commits"], name], "next": max(m["next"], written[1] + 1), "rows": m["rows"] + written[0]})

    def _read_schema(self) -> T.StructType:
        return T.StructType([*(T.StructField(f.name, f.dataType, True) for f in self.schema), T.StructField("__commit", T.StringType()), T.StructField("__part", T.LongType())])

    def scan(self) -> DataFrame:
        """The newest snapshot, and rows that wait in this writer's memory."""
        m = self._manifest()
        if not m["commits"]:
            return self._waiting(m) if self.hot else self.spark.createDataFrame([], self.schema)
        out = self._parts(m).drop("__part", "__commit")
        return out.unionByName(self._waiting(m)) if self.hot else out

    def _parts(self, m: dict) -> DataFrame:
        """All commits in one read, so that the plan doesn't grow with them."""
        return self.spark.read.schema(self._read_schema()).option("basePath", f"{self.path}/commits").parquet(*(f"{self.path}/{c}" for c in m["commits"]))

    @contextmanager
    def pinned(self) -> Iterator[DataFrame]:
        """The newest snapshot, whose files no ``retire`` deletes until the block is left."""
        m = self._manifest()
        mark = self._p(f"_readers/{uuid.uuid4().hex}.{m['version']}")
        self._fs.create(mark).close()
        try:
            yield self._parts(m).drop("__part", "__commit") if m["commits"] else self.spark.createDataFrame([], self.schema)
        finally:
            self._fs.delete(mark, False)

    def _pinned_versions(self) -> set[int]:
        if not self._fs.exists(self._p("_readers")):
            return set()
        return {int(s.getPath().getName().rpartition(".")[2]) for s in self._fs.listStatus(self._p("_readers"))}

    def file_ranges(self) -> DataFrame:
        """file, low, high, n: the indexes that each committed file holds; the scan reads no other column."""
        m = self._manifest()
        if not m["commits"]:
            return self.spark.createDataFrame([], "file string, low long, high long, n long")
        i = F.col(f"{self.prefix}.index")
        return self._parts(m).groupBy(F.input_file_name().alias("file")).agg(F.min(i).alias("low"), F.max(i).alias("high"), F.count("*").alias("n"))

    def next_index(self) -> int:
        return self._manifest()["next"] + len(self.hot)

    def length(self) -> int:
        return self._manifest()["rows"] + len(self.hot)

    def page(self, offset: int, limit: int) -> DataFrame:
        """Rows offset .. offset + limit - 1 in index order; where indexes are dense this is a range that prunes."""
        self.flush()
        m = self._manifest()
        if not m["commits"]:
            return self.scan()
        i = F.col(f"{self.prefix}.index")
        if m["rows"] == m["next"]:
            inside = (i >= offset) & (i < offset + limit) & F.col("__part").between(offset // PART_ROWS, (offset + limit) // PART_ROWS)
            return self._parts(m).where(inside).drop("__part", "__commit").orderBy(i)
        return self._parts(m).drop("__part", "__commit").orderBy(i).offset(offset).limit(limit)

    def get(self, index: int) -> dict:
        """The row with that index, else NotFound."""
        m = self._manifest()
        if 0 <= index - m["next"] < len(self.hot):
            return self._waiting(m).where(F.col(f"{self.prefix}.index") == index).first().asDict(recursive=True)
        rows = self._parts(m).where((F.col("__part") == index // PART_ROWS) & (F.col(f"{self.prefix}.index") == index)).drop("__part", "__commit").limit(1).collect() if m["commits"] else []
        if not rows:
            raise NotFound(index)
        return rows[0].asDict(recursive=True)

    def compact(self) -> None:
        """All commits into one, sorted by index; readers of older snapshots aren't disturbed."""
        m = self._manifest()
        if len(m["commits"]) > 1:
            rows = self._parts(m).drop("__part", "__commit").repartitionByRange(F.col(f"{self.prefix}.index"))
            self._commit(m | {"commits": [self._write(rows)]})

    def retire(self, older_than_s: float = 86_400) -> int:
        """Deletes commits that neither the newest manifest nor a pinned reader's names, and manifests before it, once they are old enough."""
        m, gone, now = self._manifest(), 0, time.time() * 1000
        held = {m["version"]: m}
        for v in self._pinned_versions() - {m["version"], 0}:
            held[v] = json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/_manifests/{v:012d}.json", wholetext=True).collect()))
        commits = {c.rpartition("/")[2] for x in held.values() for c in x["commits"]}
        for place, keep in (("commits", commits), ("_manifests", {f"{v:012d}.json" for v in held})):
            if self._fs.exists(self._p(place)):
                for s in self._fs.listStatus(self._p(place)):
                    if s.getPath().getName() not in keep and now - s.getModificationTime() >= older_than_s * 1000:
                        gone += bool(self._fs.delete(s.getPath(), True))
        return gone


def page_of(df: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    """A page of any frame by a unique, ordered column."""
    return df.orderBy(order).offset(offset).limit(limit)


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key; a ranking, so ties in ``order`` are broken by all its columns."""
    w = Window.partitionBy(key).orderBy(*(F.col(o).desc() for o in order))
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def latest_version(df: DataFrame, key: str, version: str) -> DataFrame:
    """The row with the greatest semantic version of each key; a pre-release comes before its release."""
    core, pre = F.split_part(version, F.lit("-"), F.lit(1)), F.regexp_extract(version, r"^[^-]*-(.*)$", 1)
    parts = F.transform(F.split(core, r"\."), lambda x: x.try_cast("int"))
    rank = F.struct(parts.alias("n"), (pre == "").alias("release"), pre.alias("pre"))
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), rank).alias("v")).select("v.*")
