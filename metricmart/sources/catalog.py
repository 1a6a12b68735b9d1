"""A stored keyed table with merges: buckets of keys, versions of files, and a pointer that moves at once.

``<path>/data/...`` holds the files of each merge, by bucket of the key; ``<path>/versions/<n>`` lists which folder holds
each bucket in version n. A merge reads and writes only the buckets its rows fall in and keeps the files of all others.
Its version exists once its list does, and a list is made only if it isn't there yet: readers see the version before or
after, of two merges at once one fails and may run again, and what a merge that failed has left is never read
(``vacuum`` deletes it). A merge of the same rows run again gives the same table, if its rule does.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Catalog:
    """``key``: columns that tell rows apart; ``schema``: of the table, the key included; ``buckets``: fixed by the first merge."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], schema: str, buckets: int = 64):
        self.spark, self.path, self.key, self.schema = spark, path.rstrip("/"), key, schema
        self.jvm = spark._jvm.org.apache.hadoop.fs
        self.fs = self.jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        known = self._list(self.version())
        self.buckets = known["buckets"] if known else buckets

    def _path(self, name: str):
        return self.jvm.Path(f"{self.path}/{name}")

    def version(self) -> int:
        """The last version's number; 0 before the first merge."""
        at = self._path("versions")
        return max((int(f.getPath().getName()) for f in self.fs.listStatus(at) if f.getPath().getName().isdigit()), default=0) if self.fs.exists(at) else 0

    def _list(self, version: int) -> dict | None:
        if not version:
            return None
        rows = self.spark.read.text(f"{self.path}/versions/{version}", wholetext=True).collect()  # one name a bucket
        return json.loads(rows[0].value)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _rows(self, folders: dict[int, str]) -> DataFrame:
        """Rows of these buckets, with the bucket."""
        paths = [f"{self.path}/data/{f}/bucket={b}" for b, f in sorted(folders.items())]
        if not paths:
            return self.spark.createDataFrame([], self.schema).withColumn("bucket", F.lit(0))
        return self.spark.read.schema(self.schema).parquet(*paths).withColumn("bucket", self._bucket())

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version (the last)."""
        held = self._list(self.version() if version is None else version)
        return self._rows({int(b): f for b, f in held["folders"].items()} if held else {}).drop("bucket")

    def merge(self, rows: DataFrame, rule: Callable[[DataFrame, DataFrame], DataFrame], everywhere: bool = False) -> int:
        """Replaces each touched bucket by rule(its rows, the new rows that fall in it), columns as in the table, and
        returns the new version. ``everywhere``: rules that also change rows without a new row see all buckets."""
        before = self.version()
        held = self._list(before)
        folders = {int(b): f for b, f in held["folders"].items()} if held else {}
        rows = rows.withColumn("bucket", self._bucket())
        touched = {r.bucket for r in rows.select("bucket").distinct().collect()} | (set(folders) if everywhere else set())  # at most ``buckets``
        if not touched:
            return before
        old = self._rows({b: f for b, f in folders.items() if b in touched})
        columns = [f.name for f in self.spark.createDataFrame([], self.schema).schema.fields]
        merged = rule(old.drop("bucket"), rows.drop("bucket")).select(columns).withColumn("bucket", self._bucket())
        name = f"{before + 1}-{uuid.uuid4().hex}"
        merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{name}")
        made = {int(f.getPath().getName().removeprefix("bucket=")) for f in self.fs.listStatus(self._path(f"data/{name}")) if f.getPath().getName().startswith("bucket=")}
        folders = {b: f for b, f in folders.items() if b not in touched} | dict.fromkeys(made, name)
        self._publish(before + 1, {"buckets": self.buckets, "folders": {str(b): f for b, f in sorted(folders.items())}})
        return before + 1

    def _publish(self, version: int, held: dict) -> None:
        self.fs.mkdirs(self._path("versions"))
        try:
            out = self.fs.create(self._path(f"versions/{version}"), False)  # fails where it exists
        except Exception as e:
            raise RuntimeError(f"version {version} of {self.path} was made by another merge; run this one again") from e
        out.write(json.dumps(held).encode())
        out.close()

    def vacuum(self, keep: int = 1) -> None:
        """Deletes the lists of all but the last ``keep`` versions and the files that none of these names."""
        last = self.version()
        named = {f for v in range(max(1, last - keep + 1), last + 1) for f in self._list(v)["folders"].values()}
        for v in range(1, last - keep + 1):
            self.fs.delete(self._path(f"versions/{v}"), False)
        for f in self.fs.listStatus(self._path("data")):
            if f.getPath().getName() not in named:
                self.fs.delete(f.getPath(), True)


def tracking_rule(key: str, names: list[str], now: Column, days: int = 183) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Catalog upkeep: a new key starts now and is tracked for ``days``; a known one is seen now and takes the names that
    aren't empty (a new row's last one by its ``at``); whoever's time is up is inactive; nothing is deleted. Columns: the
    key, ``names``, first_seen, last_seen, until, active. Of stored rows of one key the last seen counts."""

    def rule(old: DataFrame, new: DataFrame) -> DataFrame:
        rest = [c for c in old.columns if c != key]
        old = old.groupBy(key).agg(F.max_by(F.struct(*rest), "last_seen").alias("o"))
        said = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
        new = new.groupBy(key).agg(*[F.max_by(said(c), F.when(said(c).isNotNull(), F.struct("at", c))).alias(f"n_{c}") for c in names], F.lit(True).alias("seen"))
        both = old.join(new, key, "full_outer")
        known, seen = F.col("o").isNotNull(), F.col("seen").isNotNull()
        until = F.when(known, F.col("o.until")).otherwise(now + F.make_interval(days=F.lit(days)))
        return both.select(
            key, *[F.coalesce(f"n_{c}", f"o.{c}", F.lit("")).alias(c) for c in names], F.when(known, F.col("o.first_seen")).otherwise(now).alias("first_seen"),
            F.when(seen, now).otherwise(F.col("o.last_seen")).alias("last_seen"), until.alias("until"), (until >= now).alias("active"),
        )

    return rule


def replace_rule(key: list[str], order: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Registries: a new row takes the place of the key's old one; of several new ones the last by ``order``."""

    def rule(old: DataFrame, new: DataFrame) -> DataFrame:
        rest = [c for c in new.columns if c not in key]
        last = new.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*")
        return old.join(last.select(*key), key, "left_anti").unionByName(last.select(old.columns))

    return rule
