"""Table versions without rewriting: a log of manifests.

A version is one small file, ``_log/<number>.json``, that names the folders a
table is made of, oldest first. A folder of kind ``rows`` adds rows. A folder of
kind ``gone`` takes away the rows of its keys from all folders listed before it.
In a table with ``latest`` a key's newest row holds, so a change writes changed
rows only. Deleting a repository writes its name, whatever texts it has.

A version comes into being when its file appears, whole, under the next free
number. A writer that finds the number taken has lost: it looks at the newer
version and tries again, so no change is lost and none is made on a state its
writer has not seen. Readers keep the version they started with.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import CODEC

LOG = "_log"
KEPT = 100  # versions that can still be read
FEW = 1_000  # removed names that become literals, which prune partitions before they are listed
SMALL = 1 << 27  # folders of fewer bytes are merged by compaction
TRIES = 20


@dataclass(frozen=True)
class Part:
    folder: str
    kind: str = "rows"
    rows: int = 0
    size: int = 0
    about: dict = field(default_factory=dict)

    @property
    def folders(self) -> set[str]:
        return {self.folder, self.about.get("filters", self.folder)}


@dataclass(frozen=True)
class Version:
    number: int
    schema: str
    key: str | None = None
    latest: bool = False
    parts: tuple[Part, ...] = ()
    about: dict = field(default_factory=dict)

    @property
    def fields(self) -> StructType:
        return StructType.fromJson(json.loads(self.schema))


class Conflict(RuntimeError):
    """Other writers were faster as often as was tried."""


def _path(spark: SparkSession, place: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, place: str) -> bool:
    store, path = _path(spark, place)
    return store.exists(path)


def _entry(table: str, number: int) -> str:
    return f"{table.rstrip('/')}/{LOG}/{number:020d}.json"


def _numbers(spark: SparkSession, table: str) -> list[int]:
    store, log = _path(spark, f"{table.rstrip('/')}/{LOG}")
    if not store.exists(log):
        return []
    names = (status.getPath().getName() for status in store.listStatus(log))
    return sorted(int(name[:20]) for name in names if name[:20].isdecimal() and name.endswith(".json"))


def newest(spark: SparkSession, table: str, number: int | None = None) -> Version | None:
    """The newest version, or the one asked for; None if the table has none."""
    if number is None:
        known = _numbers(spark, table)
        if not known:
            return None
        number = known[-1]
    store, path = _path(spark, _entry(table, number))
    with_stream = store.open(path)
    try:
        found = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(with_stream, "UTF-8"))
    finally:
        with_stream.close()
    return Version(**{**found, "parts": tuple(Part(**p) for p in found["parts"])})


def _publish(spark: SparkSession, table: str, version: Version) -> bool:
    """Puts a version's file under its number as a whole; False if the number is taken.

    On local disks by a hard link, elsewhere by a rename that never overwrites.
    """
    target = _entry(table, version.number)
    store, draft = _path(spark, f"{table.rstrip('/')}/{LOG}/.{uuid.uuid4().hex}")
    out = store.create(draft, False)
    out.write(bytearray(json.dumps(asdict(version)).encode()))
    out.close()
    _, place = _path(spark, target)
    jvm = spark._jvm
    try:
        if store.getUri().getScheme() == "file":
            local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(local(place), local(draft))
        else:
            names = jvm.org.apache.hadoop.fs
            never = spark.sparkContext._gateway.new_array(names.Options.Rename, 1)
            never[0] = names.Options.Rename.NONE
            names.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, place, never)
    except Exception as problem:  # noqa: BLE001 - the gateway wraps what the store says
        if "AlreadyExists" not in f"{problem} {getattr(problem, 'java_exception', '')}":
            raise
        return False
    finally:
        store.delete(draft, False)
    return True


def _forget(spark: SparkSession, table: str, number: int) -> None:
    """Deletes a version, and the folders that the next one no longer names."""
    if number not in (known := _numbers(spark, table)) or number + 1 not in known:
        return
    old, after = newest(spark, table, number), newest(spark, table, number + 1)
    _delete(spark, table, set().union(*(p.folders for p in old.parts)) - set().union(*(p.folders for p in after.parts)))
    store, path = _path(spark, _entry(table, number))
    store.delete(path, False)


def _delete(spark: SparkSession, table: str, folders: set[str]) -> None:
    for folder in folders:
        store, path = _path(spark, f"{table.rstrip('/')}/{folder}")
        store.delete(path, True)


def commit(spark: SparkSession, table: str, build: Callable[[Version | None], Version | None], tries: int = TRIES, kept: int = KEPT) -> Version:
    """Publishes what ``build`` makes of the newest version, again and again until no one is faster.

    ``build`` gets None for a table without versions; giving back None leaves the
    table as it is. ``kept`` versions stay readable. Folders that a lost try wrote,
    and that the try which won does not name, are deleted.
    """
    lost: set[str] = set()
    for _ in range(tries):
        now = newest(spark, table)
        after = build(now)
        if after is None or after is now:
            return now
        after = replace(after, number=(now.number if now else 0) + 1)
        before = set().union(*(p.folders for p in now.parts)) if now else set()
        mine = set().union(*(p.folders for p in after.parts)) - before
        if _publish(spark, table, after):
            _delete(spark, table, lost - mine)
            _forget(spark, table, after.number - kept)
            return after
        lost |= mine
    raise Conflict(f"{table}: {tries} versions were taken by other writers")


def write_part(table: str, rows: DataFrame, kind: str = "rows", partition: str | None = None, **about) -> Part:
    """Writes a folder that no version names yet."""
    spark, name = rows.sparkSession, f"data/{uuid.uuid4().hex}"
    place = f"{table.rstrip('/')}/{name}"
    if partition:
        rows = rows.hint("rebalance", partition)
    rows.write.option("compression", CODEC).partitionBy(*([partition] if partition else [])).parquet(place)
    store, path = _path(spark, place)
    written = spark.read.schema(rows.schema).parquet(place)
    return Part(name, kind, written.count(), store.getContentSummary(path).getLength(), about)


def create(spark: SparkSession, table: str, rows: DataFrame, key: str, latest: bool = False) -> Version:
    """A table's first version. ``key`` names its rows in changes and removals.

    Tables with ``latest`` hold one row per key; the others are partitioned by it.
    """

    def build(now: Version | None) -> Version:
        if now is not None:
            raise FileExistsError(f"{table} has versions")
        part = write_part(table, rows, partition=None if latest else key)
        return Version(1, rows.schema.json(), key, latest, (part,))

    return commit(spark, table, build)


def read_part(spark: SparkSession, table: str, version: Version, part: Part) -> DataFrame:
    fields = version.fields if part.kind == "rows" else StructType([f for f in version.fields if f.name == version.key])
    return spark.read.schema(fields).parquet(f"{table.rstrip('/')}/{part.folder}").select(*fields.names)


def read(spark: SparkSession, table: str, number: int | None = None) -> DataFrame:
    """The rows of the newest version, or of the one asked for."""
    version = newest(spark, table, number)
    if version is None:
        raise ValueError(f"no version of {table}")
    return _rows(spark, table, version, version.parts)


def _rows(spark: SparkSession, table: str, version: Version, parts: tuple[Part, ...]) -> DataFrame:
    """What a run of parts holds, as if it were the whole table."""
    key, found = version.key, None
    for at, part in enumerate(parts):
        if part.kind != "rows":
            continue
        rows = _without(spark, table, version, read_part(spark, table, version, part), [p for p in parts[at:] if p.kind == "gone"])
        rows = rows.withColumn("_at", F.lit(at))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return spark.createDataFrame([], version.fields)
    if version.latest and sum(p.kind == "rows" for p in parts) > 1:
        names = version.fields.names
        newest_row = found.groupBy(key).agg(F.max_by(F.struct(*names), "_at").alias("_row"))
        return newest_row.select(*[F.col(f"_row.{n}").alias(n) for n in names])
    return found.drop("_at")


def _without(spark: SparkSession, table: str, version: Version, rows: DataFrame, gone: list[Part]) -> DataFrame:
    """Rows less those of removed keys.

    Few keys become literals: the partitions they name are not even listed. Many
    are joined as a plain table, so AQE can split a key with very many rows.
    """
    if not gone:
        return rows
    key, names = version.key, None
    for part in gone:
        some = read_part(spark, table, version, part)
        names = some if names is None else names.unionByName(some)
    if sum(p.rows for p in gone) <= FEW:
        listed = [r[0] for r in names.distinct().collect()]
        return rows.where(F.col(key).isNull() | ~F.col(key).isin(listed))
    return rows.join(names, key, "left_anti")


def append(spark: SparkSession, table: str, rows: DataFrame) -> Version:
    """Adds rows; they are written once, however many writers are at work."""
    now = newest(spark, table)
    part = write_part(table, rows.select(*now.fields.names), partition=None if now.latest else now.key)
    return commit(spark, table, lambda v: replace(v, parts=(*v.parts, part)))


def remove(spark: SparkSession, table: str, names: DataFrame) -> Version:
    """Takes away all rows whose key is in ``names`` (one column); only the names are written."""
    now = newest(spark, table)
    part = write_part(table, names.select(F.col(names.columns[0]).alias(now.key)).where(F.col(now.key).isNotNull()).distinct(), "gone")
    return commit(spark, table, lambda v: replace(v, parts=(*v.parts, part)))


def change(spark: SparkSession, table: str, work: Callable[[DataFrame], DataFrame]) -> Version:
    """Adds the rows that ``work`` makes of the newest state, which it sees anew if another writer was faster."""

    def build(now: Version | None) -> Version:
        part = write_part(table, work(_rows(spark, table, now, now.parts)).select(*now.fields.names))
        return replace(now, parts=(*now.parts, part))

    return commit(spark, table, build)


def compact(spark: SparkSession, table: str, small: int = SMALL, over: int = 1) -> Version:
    """Merges the newest folders, as far back as they are small, into one.

    Large folders stay as they are, and so does what was removed from them. What
    others add meanwhile is kept. Readers of older versions are not disturbed.
    """
    start = newest(spark, table)
    first = len(start.parts)
    while first and start.parts[first - 1].size < small:
        first -= 1
    merged = start.parts[first:]
    if sum(p.kind == "rows" for p in merged) <= over:
        return start
    rows = write_part(table, _rows(spark, table, start, merged), partition=None if start.latest else start.key)
    gone = [p for p in merged if p.kind == "gone"] if first else []
    names = None
    for part in gone:
        some = read_part(spark, table, start, part)
        names = some if names is None else names.unionByName(some)
    left = (write_part(table, names.distinct(), "gone"),) if gone else ()

    def build(now: Version | None) -> Version | None:
        if now.parts[: len(start.parts)] != start.parts:
            return None  # merged by another writer
        return replace(now, parts=(*start.parts[:first], *left, rows, *now.parts[len(start.parts) :]))

    return commit(spark, table, build)

