"""Written tables: versions below one folder, and builds that readers go over to all at once.

A build writes new versions next to the old ones and then one small file that names the version of
every table. The file gets its name by a rename, so a reader sees a build whole or not at all, and a
build that fails leaves the one before in use. With each version the file records what the write
counted: rows, and the values of every column. Counting is part of the write, not another read.

Versions that the last two builds do not name are deleted; older readers have ended by then.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from types import TracebackType

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUILDS = "_builds"
KEPT_BUILDS = 2


@dataclass(frozen=True)
class Version:
    """Where a table's rows are, and what was counted as they were written.

    An appended version has several parts. `by` names the directory column of a partitioned table, which
    is not one of its own. `profile` is the folder of its column profiles, if they were taken.
    """

    parts: list[str]
    schema: str
    rows: int
    values: dict[str, int]
    by: str | None = None
    profile: str | None = None


@dataclass(frozen=True)
class Build:
    number: int
    tables: dict[str, Version]
    sources: str | None = None
    measures: dict[str, float] = field(default_factory=dict)


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path as it wants it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def delete(spark: SparkSession, path: str) -> None:
    files, target = file_system(spark, path)
    files.delete(target, True)


def _build_files(spark: SparkSession, folder: str) -> list:
    files, pattern = file_system(spark, f"{folder}/{BUILDS}/build=*.json")
    return sorted((status.getPath() for status in files.globStatus(pattern) or []), key=lambda path: path.getName())


def _read_build(spark: SparkSession, path) -> Build:
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = files.open(path)
    try:
        found = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    found["tables"] = {name: Version(**version) for name, version in found["tables"].items()}
    return Build(**found)


def latest(spark: SparkSession, folder: str) -> Build | None:
    """The newest complete build below a folder."""
    found = _build_files(spark, folder)
    return _read_build(spark, found[-1]) if found else None


def builds(spark: SparkSession, folder: str) -> list[Build]:
    """The builds that are kept, oldest first."""
    return [_read_build(spark, path) for path in _build_files(spark, folder)]


def read(spark: SparkSession, folder: str, version: Version, with_directory: bool = False) -> DataFrame:
    """The rows of a version, with the directory column of a partitioned table if asked for."""
    schema = StructType.fromJson(json.loads(version.schema))
    paths = [f"{folder}/{part}" for part in version.parts]
    if not version.by:
        return spark.read.schema(schema).parquet(*paths)
    whole = spark.read.schema(StructType(schema.fields).add(version.by, "string")).parquet(*paths)
    return whole if with_directory else whole.select(*schema.names)


def observed(watch: Observation, otherwise: Callable[[], dict]) -> dict:
    """What an observation saw. Where adaptive execution finds out that a part of a plan is empty it leaves that part
    out, with what it was to observe; then `otherwise` says it."""
    try:
        return watch.get
    except Py4JJavaError:
        return otherwise()


class BuildError(RuntimeError):
    """A build that may not be published."""


class Builder:
    """Writes the tables of one build; used in a `with` statement, which takes them away if it fails.

    Tables that a build does not write stay as the build before has them.
    """

    def __init__(self, spark: SparkSession, folder: str, sources: str | None = None) -> None:
        self.spark, self.folder, self.sources = spark, folder, sources
        self.before = latest(spark, folder)
        self.number = self.before.number + 1 if self.before else 1
        self.tables: dict[str, Version] = dict(self.before.tables) if self.before else {}
        self.measures: dict[str, float] = {}
        self.written: list[str] = []
        self.published = False

    def __enter__(self) -> Builder:
        return self

    def __exit__(self, kind: type | None, error: BaseException | None, trace: TracebackType | None) -> None:
        if not self.published:
            for part in self.written:
                delete(self.spark, f"{self.folder}/{part}")

    def new_part(self, name: str) -> str:
        """A new folder for rows of a table, below the folder of the store."""
        part = f"{name}/version={self.number:08}-{uuid.uuid4().hex[:8]}"
        self.written.append(part)
        return part

    def _store(self, df: DataFrame, path: str, by: str | None, measures: Mapping[str, Column]) -> tuple[int, dict[str, int]]:
        """Write rows and count them and the values of their columns in the same pass."""
        watch = Observation()
        names = [c for c in df.columns if c != by]
        counts = [F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(names)]
        named = [measure.alias(f"m_{i}") for i, measure in enumerate(measures.values())]
        watched = df.observe(watch, F.count(F.lit(1)).alias("rows"), *counts, *named)
        if by:
            # A frequent directory is spread over tasks, rare ones share one.
            watched = watched.hint("rebalance", by)
        writer = watched.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        (writer.partitionBy(by) if by else writer).parquet(path)
        nothing = df.limit(0).agg(F.count(F.lit(1)).alias("rows"), *counts, *named)
        found = observed(watch, lambda: nothing.first().asDict())
        self.measures |= {key: found[f"m_{i}"] for i, key in enumerate(measures)}
        return found["rows"], {c: found[f"_{i}"] for i, c in enumerate(names)}

    def write(self, name: str, df: DataFrame, by: Column | None = None, directory: str | None = None,
              measures: Mapping[str, Column] | None = None) -> DataFrame:
        """Write a table as a new version and return it as written.

        With `by`, rows go to one directory for each of its values, which is called `directory`.
        `measures` are aggregates to take on the way, by name.
        """
        part = self.new_part(name)
        rows, values = self._store(
            df.withColumn(directory, by) if directory else df, f"{self.folder}/{part}", directory, measures or {}
        )
        self.tables[name] = Version([part], df.schema.json(), rows, values, directory)
        return read(self.spark, self.folder, self.tables[name])

    def append(self, name: str, df: DataFrame) -> None:
        """Add rows to a table: the version before, and one more part."""
        old = self.tables.get(name)
        if old is None:
            self.write(name, df)
            return
        if old.by:
            raise BuildError(f"{name} is written by {old.by}; replace a directory of it")
        part = self.new_part(name)
        rows, values = self._store(df, f"{self.folder}/{part}", None, {})
        added = {c: n + values.get(c, 0) for c, n in old.values.items()}
        self.tables[name] = Version([*old.parts, part], old.schema, old.rows + rows, added)

    def replace_directory(self, name: str, value: str, df: DataFrame) -> None:
        """Put new rows in the place of one directory of a partitioned table; the other files stay untouched.

        Readers find the new rows as soon as Spark has committed them.
        """
        old = self.tables[name]
        if not old.by:
            raise BuildError(f"{name} is not written by directories")
        path = f"{self.folder}/{old.parts[0]}"
        columns = list(old.values)
        there = read(self.spark, self.folder, old, with_directory=True).filter(F.col(old.by) == value)
        gone = there.agg(F.count(F.lit(1)), *[F.count(F.col(f"`{c}`")) for c in columns]).first()
        rows, values = self._store(df.withColumn(old.by, F.lit(value)), path, old.by, {})
        if not rows:
            delete(self.spark, f"{path}/{old.by}={value}")
        left = {c: old.values[c] - n + values[c] for c, n in zip(columns, gone[1:], strict=True)}
        self.tables[name] = Version(old.parts, old.schema, old.rows - gone[0] + rows, left, old.by)

    def profiled(self, names: Sequence[str], profile: str) -> None:
        """Name the folder that holds the profiles of these tables."""
        for name in names:
            self.tables[name] = Version(**{**asdict(self.tables[name]), "profile": profile})

    def publish(self) -> Build:
        """Make this the build that readers see."""
        build = Build(self.number, self.tables, self.sources, self.measures)
        files, target = file_system(self.spark, f"{self.folder}/{BUILDS}/build={self.number:08}.json")
        draft = target.suffix(f".{uuid.uuid4().hex}.draft")
        stream = files.create(draft)
        try:
            stream.write(bytearray(json.dumps(asdict(build)).encode()))
        finally:
            stream.close()
        if files.exists(target) or not files.rename(draft, target):
            files.delete(draft, False)
            raise BuildError(f"another build {self.number} was published in the meantime")
        self.published = True
        self._drop_old()
        return build

    def _drop_old(self) -> None:
        """Delete builds that are no longer kept, with what only they name."""
        kept = _build_files(self.spark, self.folder)
        old, kept = kept[:-KEPT_BUILDS], kept[-KEPT_BUILDS:]
        named = [
            {part for version in _read_build(self.spark, path).tables.values() for part in [*version.parts, version.profile] if part}
            for path in (*old, *kept)
        ]
        still = set().union(*named[len(old) :])
        for path, parts in zip(old, named, strict=False):
            for part in parts - still:
                delete(self.spark, f"{self.folder}/{part}")
            delete(self.spark, path.toString())
