"""A store of snapshots by content: tables under their digest, and two pointers.

``objects/<digest>`` holds a snapshot's table and ``objects/<digest>.version`` its version; the
files ``active`` and ``previous`` name digests.  A pointer is replaced by a rename over
it, so a reader finds the old or the new one, and a table that a reader has begun on is
never written again.  Works in any store that Hadoop's file systems reach, if that renames
in one step."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treesift.functions.digests import table_digest

_DIGEST = re.compile(r"[0-9a-f]{64}")
_VERSION = re.compile(r"(\d{4})\.(\d{2})\.(\d{2})\.(\d+)")


def order_of(version: str) -> tuple[date, int]:
    """(date, revision) of a version ``yyyy.mm.dd.revision``; versions are ordered by it."""
    m = _VERSION.fullmatch(version)
    if not m:
        raise ValueError(f"{version!r} is no version")
    return date(int(m[1]), int(m[2]), int(m[3])), int(m[4])


def order_column(version: Column) -> Column:
    """``order_of`` as a struct (day, revision), null for what is no version."""
    day = F.try_to_timestamp(F.regexp_extract(version, r"^(\d{4}\.\d{2}\.\d{2})\.\d+$", 1), F.lit("yyyy.MM.dd")).cast("date")
    return F.when(day.isNotNull(), F.struct(day.alias("day"), F.regexp_extract(version, r"\.(\d+)$", 1).cast("long").alias("revision")))


def as_of(history: DataFrame, dates: DataFrame, *key: str) -> DataFrame:
    """``dates`` (key..., day) with the row of ``history`` (key..., version, ...) that was the last
    on that day: by date, then revision.  Without one its columns are null.

    Versions become intervals that end where the next begins (of one day only the last
    revision counts), so each date meets one row at most and none is dropped after."""
    at = history.withColumn("order", order_column(F.col("version"))).where("order is not null")
    last = at.groupBy(*key, F.col("order.day").alias("from")).agg(F.max_by(F.struct(*history.columns), F.col("order.revision")).alias("row"))
    listed = last.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("from", "row"))).alias("rows"))  # as many as a key has versions
    until = F.transform("rows", lambda r, i: F.struct(r["from"].alias("from"), F.get("rows", i + 1)["from"].alias("until"), r["row"].alias("row")))
    spans = listed.select(*[F.col(k).alias(f"_{k}") for k in key], F.inline(until))
    meets = [dates[k] == spans[f"_{k}"] for k in key] + [dates["day"] >= spans["from"], spans["until"].isNull() | (dates["day"] < spans["until"])]
    return dates.join(spans, meets, "left").select(*[dates[c] for c in dates.columns], *[F.col(f"row.{c}").alias(c) for c in history.columns if c not in key])


@dataclass
class SnapshotStore:
    """Snapshots of one kind of table under the folder ``root``."""

    spark: SparkSession
    root: str

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root.rstrip('/')}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read(self, name: str) -> str | None:
        path, files = self._path(name), self._files()
        if not files.exists(path):
            return None
        stream = files.open(path)
        try:
            return bytes(stream.readAllBytes()).decode().strip()
        finally:
            stream.close()

    def _replace(self, name: str, text: str) -> None:
        """The file ``name`` with ``text``, in one step."""
        own = self._path(f".{name.replace('/', '-')}-{uuid.uuid4().hex}")
        files = self._files()
        stream = files.create(own, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        jvm = self.spark._jvm
        over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(own, self._path(name), over)

    def pointer(self, name: str = "active") -> str | None:
        digest = self._read(name)
        if digest is not None and not _DIGEST.fullmatch(digest):
            raise ValueError(f"pointer {name} is invalid")
        return digest

    def version(self, name: str = "active") -> str | None:
        digest = self.pointer(name)
        return self._read(f"objects/{digest}.version") if digest else None

    def update(self, table: DataFrame, version: str, today: date) -> str:
        """Publish ``table`` and point to it; the digest.  A version from the future (by more
        than a day) or older than the active one is refused with a ValueError."""
        if order_of(version)[0] > today + timedelta(days=1):
            raise ValueError(f"refusing future version {version}")
        active = self.version()
        if active and order_of(version) < order_of(active):
            raise ValueError(f"refusing older version {version}; {active} is active")
        digest = table_digest(table)
        if not self._files().exists(self._path(f"objects/{digest}/_SUCCESS")):
            table.write.mode("overwrite").parquet(f"{self.root}/objects/{digest}")
        self._replace(f"objects/{digest}.version", version)
        old = self.pointer()
        if old and old != digest:
            self._replace("previous", old)
        self._replace("active", digest)
        return digest

    def rollback(self) -> str:
        """Point to the previous snapshot, and name the one that was active as previous."""
        previous, active = self.pointer("previous"), self.pointer()
        if not previous:
            raise ValueError("there is no previous snapshot")
        self.load(previous)
        self._replace("active", previous)
        if active and active != previous:
            self._replace("previous", active)
        return previous

    def load(self, digest: str) -> DataFrame:
        """The snapshot of a digest; a ValueError if its rows have another."""
        table = self.spark.read.parquet(f"{self.root}/objects/{digest}")
        if table_digest(table) != digest:
            raise ValueError(f"snapshot {digest} does not have its digest")
        return table

    def active(self) -> DataFrame:
        digest = self.pointer()
        if not digest:
            raise ValueError("there is no active snapshot")
        return self.load(digest)
