"""Tables in versions: a keyed change writes a new version, which is there as a whole or not at all.

A version is a folder v=N of Parquet below the table's. It is written beside the others under a name of its own and renamed
once it is whole; the rename fails if another writer has made version N meanwhile, and the change is then to be made again
on what is there. Readers take the latest version, or any that they name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordered import join_same
from .registry import merge_registries


class Conflict(RuntimeError):
    """Another writer has made the version that was about to be made."""


class Versioned:
    """A table at path (of any file system that Spark reads), keyed by columns that tell its rows apart."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str):
        self.spark, self.path, self.keys, self.schema = spark, path.rstrip("/"), keys, schema
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        """The versions that there are, in order."""
        top = self.jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(self.conf)
        names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())

    def read(self, version: int | None = None) -> DataFrame:
        """A version's rows, the latest unless one is named; of a table without versions, none."""
        have = self.versions()
        if version is None and not have:
            return self.spark.createDataFrame([], self.schema)
        if version is not None and version not in have:
            raise ValueError(f"no version {version}; there are {have}")
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={have[-1] if version is None else version}")

    def commit(self, rows: DataFrame, base: int | None = None) -> int:
        """Makes rows the version after base (the latest) and returns its number."""
        version = (self.versions() or [0])[-1] + 1 if base is None else base + 1
        new = f"_new-{uuid.uuid4().hex}"
        names = self.spark.createDataFrame([], self.schema).columns
        rows.select(*names).write.parquet(f"{self.path}/{new}")
        target = self.at(f"v={version}")
        fs = target.getFileSystem(self.conf)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf)
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(self.at(new)), fs.makeQualified(target), none)
        except Exception as e:
            fs.delete(self.at(new), True)
            if fs.exists(target):
                raise Conflict(f"version {version} is there already") from e
            raise
        return version

    def changed(self, make, changes: DataFrame) -> int:
        base = (self.versions() or [0])[-1]
        return self.commit(make(self.read(), changes), base)

    def upsert(self, changes: DataFrame, order: str | None = None) -> int:
        """Rows of changes replace those of equal keys and are added else; of changes of equal keys that of the largest
        order counts, ties (and changes without an order) by the other columns."""
        names = self.spark.createDataFrame([], self.schema).columns
        others = [c for c in names if c not in self.keys]
        best = changes.groupBy(*self.keys).agg(F.max(F.struct(*([F.col(order).alias("_order")] if order else []), *others)).alias("_b"))
        rows = best.select(*[F.col(c) if c in self.keys else F.col(f"_b.{c}").alias(c) for c in names])
        return self.changed(lambda was, new: join_same(was, new.select(*self.keys), self.keys, "left_anti").unionByName(new), rows)

    def add(self, rows: DataFrame) -> int:
        """Only rows whose first key is not there are added; what is there stays."""
        return self.changed(lambda was, new: merge_registries(was, new, self.keys[0]), rows)

    def remove(self, keys: DataFrame) -> int:
        """Rows of these keys go."""
        return self.changed(lambda was, gone: join_same(was, gone.select(*self.keys).distinct(), self.keys, "left_anti"), keys)

    def changes(self, a: int, b: int) -> DataFrame:
        """(*keys, change) between two versions: added, removed or modified."""
        names = [c for c in self.spark.createDataFrame([], self.schema).columns if c not in self.keys]
        side = lambda v, n: self.read(v).select(*self.keys, F.struct(F.lit(1).alias("there"), *names).alias(n))
        was, now = side(a, "_a"), side(b, "_b")
        both = was.unionByName(now, allowMissingColumns=True).groupBy(*self.keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
        change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "modified")
        return both.select(*self.keys, change.alias("change")).where("change is not null")

    def export(self, path: str, version: int | None = None) -> None:
        """Writes a version as JSON lines."""
        self.read(version).write.mode("overwrite").json(path)


CAMERA = "id string, make string, model string, variants array<string>, filename_patterns array<string>, folder_patterns array<string>, category string, medium string, year int"


def load_cameras(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(ord, source, camera columns) of JSON documents by source: an array of cameras or an object with one under `cameras`.
    Sources follow each other in their order; one that is missing or no JSON has no cameras; unknown members are left out."""
    out = None
    for k, (source, path) in enumerate(paths.items()):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            continue
        text = spark.read.text(path, wholetext=True)
        kind = f"array<struct<{CAMERA}>>"
        many = F.when(F.ltrim("value").startswith("["), F.from_json("value", kind)).otherwise(F.from_json("value", f"cameras {kind}")["cameras"])
        d = text.select(F.posexplode(many).alias("_p", "_c")).where("_c.id is not null")
        d = d.select((F.col("_p") + k * 1_000_000_000).cast("long").alias("ord"), F.lit(source).alias("source"), "_c.*")
        out = d if out is None else out.unionByName(d)
    return out if out is not None else spark.createDataFrame([], f"ord long, source string, {CAMERA}")
