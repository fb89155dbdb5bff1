"""A file-system scan as a Python data source: spark.read.format("fsscan").

Options: path; recursive (true), includeHidden (false), exclude (newline-joined ignore patterns,
in place of the defaults and ignore files), minSize, maxSize (inclusive), followSymlinks (false),
content (false). A row per file: path, rel_path, dir, base, ext, size, mtime, is_symlink, content,
error. A folder that cannot be read is a row with an error. Zero-byte files and names with a
leading underscore are listed; paths must be reachable from the executors.

Partitions are folders' entries: the driver lists folders, breadth first, until there are tasks (64) of them, and each
task walks what lies below its own. Filters on size, ext and base are pushed into the scan (register() turns that on), so that
no content is read of files that they leave out. scan_levels() lists a tree level by level, every level dealt anew over
all tasks, for trees of which a few deep folders hold most.
"""

from __future__ import annotations

import datetime as dt
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from attestra.functions.paths import DEFAULT_IGNORES, ignore_lines, ignore_regex
from attestra.operators.graph import cut

SCHEMA = "path string, rel_path string, dir string, base string, ext string, size bigint, mtime timestamp, is_symlink boolean, content binary, error string"
#: The name of ignore files unless an option (ignoreFile) gives another.
IGNORE_FILE = ".scanignore"
#: Comparisons that a scan settles itself.
PUSHED = {GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v, EqualTo: lambda x, v: x == v, In: lambda x, v: x in v}


class Folder(InputPartition):
    """Entries of a folder (relative to the root), to be walked; None: the root cannot be listed."""

    def __init__(self, folder, names, seen):
        self.folder, self.names, self.seen = folder, names, seen


class Reader(DataSourceReader):
    def __init__(self, options):
        flag = lambda k, d: str(options.get(k, d)).lower() == "true"
        self.root = options.get("path") or "."
        self.recursive, self.hidden = flag("recursive", True), flag("includeHidden", False)
        self.follow, self.content = flag("followSymlinks", False), flag("content", False)
        self.least, self.most = (int(options[k]) if options.get(k) else None for k in ("minSize", "maxSize"))
        self.tasks, self.tests = int(options.get("tasks", 64)), []
        ignore_file = options.get("ignoreFile", IGNORE_FILE)
        if options.get("exclude") is not None:
            patterns = options["exclude"].split("\n")
        else:
            patterns = list(DEFAULT_IGNORES)
            for at in (os.path.expanduser("~"), self.root):
                try:
                    with open(os.path.join(at, ignore_file), encoding="utf-8") as f:
                        patterns += ignore_lines(f.read())
                except OSError:
                    pass
        self.rules = [(re.compile(r[0]), r[1]) for p in patterns if (r := ignore_regex(p))]

    def ignored(self, rel, folder):
        out = False
        for regex, negated in self.rules:
            if regex.match(rel) or (folder and regex.match(rel + "/x") and not regex.match(rel + "x/x")):
                out = not negated
        return out

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            value = getattr(f, "value", None)
            if type(f) in PUSHED and name in ("size", "ext", "base") and value is not None:
                self.tests.append((name, type(f), value))
            else:
                yield f

    def wanted(self, name, size):
        """Whether a file passes the bounds and the pushed filters."""
        have = {"size": size, "base": name, "ext": os.path.splitext(name)[1]}
        return (self.least is None or size >= self.least) and (self.most is None or size <= self.most) and all(PUSHED[kind](have[c], v) for c, kind, v in self.tests)

    def partitions(self):
        try:
            todo = [Folder("", sorted(os.listdir(self.root)), frozenset({os.path.realpath(self.root)}))]
        except OSError:
            return [Folder(None, [], frozenset())]
        done = []
        while todo and len(todo) + len(done) < self.tasks:
            at = todo.pop(0)
            files, below = [], []
            for name in at.names:
                kind, rel, full, _ = self.entry(at.folder, name)
                real = os.path.realpath(full)
                try:
                    if kind == "folder" and self.recursive and real not in at.seen:
                        below.append(Folder(rel, sorted(os.listdir(full)), at.seen | {real}))
                    elif kind == "file":
                        files.append(name)
                except OSError:
                    files.append(name)  # its task tells the error
            todo += below
            if files or not (below or todo):
                done.append(Folder(at.folder, files, at.seen))
        return [Folder(p.folder, p.names[k::n], p.seen) for p in done + todo for n in [max(1, min(self.tasks, len(p.names) // 1000))] for k in range(n)]

    def row(self, full, rel, stat=None, link=False, error=None):
        base = os.path.basename(rel)
        data = None
        if self.content and stat is not None and error is None:
            try:
                with open(full, "rb") as f:
                    data = f.read()
            except OSError as e:
                error = f"{type(e).__name__}: {e.strerror}"
        when = None if stat is None else dt.datetime.fromtimestamp(stat.st_mtime, dt.timezone.utc)
        return (full, rel, os.path.dirname(rel), base, os.path.splitext(base)[1], None if stat is None else stat.st_size, when, link, data, error)

    def entry(self, folder, name):
        """(kind, path from the root, path, is a link); kind is folder, file or None for what is left out."""
        rel = os.path.join(folder, name) if folder else name
        full = os.path.join(self.root, rel)
        link, is_dir = os.path.islink(full), os.path.isdir(full)
        out = (not self.hidden and name.startswith(".")) or self.ignored(rel, is_dir) or (link and not self.follow)
        return None if out else "folder" if is_dir else "file", rel, full, link

    def walk(self, names, folder, seen):
        for name in sorted(names):
            kind, rel, full, link = self.entry(folder, name)
            try:
                if kind == "folder":
                    real = os.path.realpath(full)
                    if self.recursive and real not in seen:
                        yield from self.walk(os.listdir(full), rel, seen | {real})
                elif kind == "file":
                    stat = os.stat(full)
                    if self.wanted(name, stat.st_size):
                        yield self.row(full, rel, stat, link)
            except OSError as e:
                yield self.row(full, rel, error=f"{type(e).__name__}: {e.strerror}")

    def read(self, partition):
        if partition.folder is None:
            yield self.row(self.root, "", error="cannot be read")
        else:
            yield from self.walk(partition.names, partition.folder, partition.seen)


class FsScan(DataSource):
    @classmethod
    def name(cls):
        return "fsscan"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FsScan)


def scan(spark: SparkSession, path: str, **options) -> DataFrame:
    """The files under path."""
    register(spark)
    r = spark.read.format("fsscan").option("path", path)
    for k, v in options.items():
        r = r.option(k, "\n".join(v) if isinstance(v, (list, tuple)) else str(v).lower() if isinstance(v, bool) else v)
    return r.load()


def scan_levels(spark: SparkSession, path: str, **options) -> DataFrame:
    """What scan() gives, without contents, by a job for each level of the tree: a level's folders are dealt over all tasks,
    whichever folder they lie in, and what is found is kept in the checkpoint folder. A level costs a job, a folder no more
    than its own listing."""
    reader = Reader({"path": path} | {k: "\n".join(v) if isinstance(v, (list, tuple)) else v for k, v in options.items()})
    names = [f.split()[0] for f in SCHEMA.split(", ") if not f.startswith("content")]
    schema = ", ".join(f for f in SCHEMA.split(", ") if not f.startswith("content"))
    kinds = pa.schema([(n, {"size": pa.int64(), "mtime": pa.timestamp("us", "UTC"), "is_symlink": pa.bool_()}.get(n, pa.string())) for n in names] + [("folder", pa.string()), ("seen", pa.list_(pa.string()))])

    def expand(batches):
        for b in batches:
            for folder, seen in zip(b.column("folder").to_pylist(), b.column("seen").to_pylist(), strict=True):
                rows, below = [], []
                full = os.path.join(reader.root, folder) if folder else reader.root
                try:
                    for name in os.listdir(full):
                        kind, rel, at, _ = reader.entry(folder, name)
                        if kind == "folder" and reader.recursive and os.path.realpath(at) not in seen:
                            below.append((rel, [*seen, os.path.realpath(at)]))
                        elif kind == "file":
                            rows += reader.walk([name], folder, frozenset(seen))
                except OSError as e:
                    rows.append(reader.row(full, folder, error="cannot be read" if not folder else f"{type(e).__name__}: {e.strerror}"))
                out = [(*r[:8], r[9], None, None) for r in rows] + [(*[None] * 9, *x) for x in below]
                for k in range(0, len(out), 5000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[k : k + 5000], strict=True), kinds, strict=True)], schema=kinds)

    todo = spark.createDataFrame([("", [os.path.realpath(reader.root)])], "folder string, seen array<string>")
    found = None
    while True:
        level = cut(todo.mapInArrow(expand, f"{schema}, folder string, seen array<string>"))
        files = level.where("folder is null").select(*names)
        found = files if found is None else found.union(files)
        below = level.where("folder is not null").select("folder", "seen")
        if not (n := below.count()):
            return found
        todo = below.repartition(min(n, spark.sparkContext.defaultParallelism * 4), "folder")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Every file, hidden ones too, without ignore rules."""
    return scan(spark, path, includeHidden=True, exclude="")


MEDIA = (".jpg", ".jpeg", ".png", ".heic", ".heif", ".tiff", ".tif", ".raw", ".cr2", ".cr3", ".nef", ".arw", ".dng", ".mp4", ".mov", ".avi", ".mts", ".m2ts")
IMAGES = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".tiff", ".tif", ".bmp", ".heic", ".heif", ".avif", ".svg")


def of_extensions(files: DataFrame, extensions=MEDIA) -> DataFrame:
    """Those visible files that have one of the extensions, whatever the case."""
    return files.where(F.lower("ext").isin(*extensions) & ~F.col("base").startswith("."))


def copy_pairs(files: DataFrame, destination: str) -> DataFrame:
    """(source, destination) of a copy of the tree."""
    return files.select(F.col("path").alias("source"), F.concat_ws("/", F.lit(destination.rstrip("/")), "rel_path").alias("destination"))
