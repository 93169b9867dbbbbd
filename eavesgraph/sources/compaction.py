"""Records in very many small files, and their consolidation.

Two parts: the records of small text bodies and which copy of each stays, and a
partitioned Parquet table whose partitions with many small files are rewritten
under snapshot versions.
"""

from __future__ import annotations

import json
import math
import os
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eavesgraph.operators.integrity import frame_key
from eavesgraph.operators.skew import heavy_keys, join_by_weight
from eavesgraph.session import broadcast_if_small, hadoop_fs, written

RECORD = ["kind", "frame_id", "point_id", "x", "y", "z"]
WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def frame_of() -> Column:
    """The frame of a small file: frame_id or, if null, the third part of file_path."""
    return frame_key(F.coalesce("frame_id", F.split_part("file_path", F.lit("/"), F.lit(3))))


def body_records(files: DataFrame) -> DataFrame:
    """One row per record line of the bodies of small files.

    files: file_id, file_path, frame_id, kind, written_at, body; other columns
    are ignored. Lines are divided at LF and counted from 1, then trimmed of
    white space; empty lines and comments (``#``) are no records. The frame is
    frame_id or, if null, the third part of file_path, trimmed and lower-cased.

    A line that is not four numbers keeps null fields and its text in
    ``malformed``. A null body has no lines.
    """
    lines = files.select("file_id", "kind", frame_of().alias("frame_id"), "written_at", F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(WHITE))).where("line <> '' and not startswith(line, '#')")
    sound = F.col("line").rlike(f"^{NUMBER}(?:[ \t]+{NUMBER}){{3}}$")
    plain = F.when(F.col("line").rlike("\t|  "), F.regexp_replace("line", "[ \t]+", " ")).otherwise(F.col("line"))
    parts = lines.withColumn("f", F.when(sound, F.split(plain, " ")))
    return parts.select("file_id", (F.col("pos") + 1).alias("line_no"), "written_at", "kind", "frame_id", *[F.col("f")[i].try_cast("double").alias(c) for i, c in enumerate(RECORD[2:])], F.when(F.col("f").isNull(), F.col("line")).alias("malformed"))


def landing_partitions(files: DataFrame, small_bytes: int = 64 << 20) -> DataFrame:
    """(kind, frame_id, n_files, n_small, n_bytes) of the landing partitions, measured on the bodies (n_bytes may be stale or absent)."""
    size = F.coalesce(F.octet_length("body"), F.lit(0))
    return files.groupBy("kind", frame_of().alias("frame_id")).agg(F.count("*").alias("n_files"), F.count_if(size < small_bytes).alias("n_small"), F.sum(size.cast("long")).alias("n_bytes"))


def surplus_copies(records: DataFrame) -> DataFrame:
    """The copies of records other than the first by (written_at, file_id, line_no).

    Equal records have equal kind, frame and numbers. Firsts are found by a
    partial aggregate, so a record delivered any number of times is no hot
    group; of the records that occur more than once the heaviest meet a
    broadcast side. Malformed lines are never copies. Null written_at comes first.
    """
    at = F.struct("written_at", "file_id", "line_no")
    keyed = records.where("malformed is null")
    first, _ = written(keyed.groupBy(*RECORD).agg(F.min(at).alias("kept"), F.count("*").alias("n")).where("n > 1"), "repeated")
    heavy = heavy_keys(first, RECORD)
    return join_by_weight(keyed, first.drop("n"), RECORD, heavy, "inner").where(~at.eqNullSafe(F.col("kept"))).select("file_id", "line_no")


def unique_records(records: DataFrame) -> DataFrame:
    """Every record exactly once, where its first copy stood; malformed lines all stay.

    A column ``copies``, if there is one, is added up.
    """
    at = F.struct("written_at", "file_id", "line_no")
    copies = F.sum("copies") if "copies" in records.columns else F.count("*")
    once = records.where("malformed is null").groupBy(*RECORD).agg(F.min(at).alias("at"), copies.alias("copies"))
    odd = records.where("malformed is not null").select(*RECORD, at.alias("at"), F.lit(1).cast("long").alias("copies"), "malformed")
    out = once.withColumn("malformed", F.lit(None).cast("string")).unionByName(odd)
    return out.select(*RECORD, "at.written_at", "at.file_id", "at.line_no", "malformed", "copies")


class Conflict(RuntimeError):
    """Another writer published other files of a partition after the snapshot this write started from."""


@dataclass
class Snapshot:
    """A version of the table.

    partitions: for each partition the generations (folders under ``data``)
    that hold its files, with files, bytes and rows of each and the number of
    files by the power of two of their size. landed: generations that wait for
    a consolidation. settings: what the table was made with.
    """

    version: int = 0
    partitions: dict[str, dict[str, dict]] = field(default_factory=dict)
    landed: list[str] = field(default_factory=list)
    settings: dict = field(default_factory=dict)


class SnapshotTable:
    """A partitioned Parquet table with numbered snapshots.

    Every write goes to a folder of its own, a generation, by a dynamic
    partition overwrite, so a repeated task or job replaces only its own
    partitions. A snapshot ``_snapshots/<version>.json`` names the generations
    of each partition; it appears whole under its name or not at all, and of
    two writers only one can take a version. The other starts again from the
    newer snapshot: an append always can, a rewrite only if its partitions are
    unchanged; otherwise it raises Conflict. Readers see the generations of one
    snapshot and nothing else, so a writer that dies at any moment leaves
    nothing but a folder that vacuum() removes. There are no locks. Files are
    listed and measured by the executors; the driver holds one entry a partition.

    Versions are taken by a hard link on a local file system and by a rename,
    which must fail if the name is taken, on others.
    """

    def __init__(self, spark: SparkSession, path: str, by: list[str], schema: StructType | None = None):
        self.spark, self.path, self.by, self.schema = spark, path.rstrip("/"), by, schema

    def _versions(self) -> list[int]:
        fs, p = hadoop_fs(self.spark, f"{self.path}/_snapshots")
        return sorted(int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")) if fs.exists(p) else []

    def snapshot(self, version: int) -> Snapshot:
        return Snapshot(**json.loads(self._read(f"{self.path}/_snapshots/{version:08d}.json")))

    def current(self) -> Snapshot:
        """The newest published snapshot; version 0 if there is none."""
        versions = self._versions()
        return self.snapshot(versions[-1]) if versions else Snapshot()

    def listing(self) -> dict[str, dict[str, dict]]:
        """The partitions of the newest snapshot."""
        return self.current().partitions

    def _read(self, path: str) -> str:
        fs, p = hadoop_fs(self.spark, path)
        stream = fs.open(p)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _claim(self, version: int, text: str) -> bool:
        """Publish a snapshot under a version; False if it is taken."""
        base = f"{self.path}/_snapshots"
        fs, made = hadoop_fs(self.spark, f"{base}/{uuid.uuid4().hex}.tmp")
        fs.mkdirs(made.getParent())
        stream = fs.create(made, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        final = hadoop_fs(self.spark, f"{base}/{version:08d}.json")[1]
        try:
            if fs.getUri().getScheme() == "file":
                try:
                    os.link(made.toUri().getPath(), final.toUri().getPath())
                except FileExistsError:
                    return False
                return True
            return not fs.exists(final) and fs.rename(made, final)
        finally:
            fs.delete(made, False)

    def _key(self) -> Column:
        """The name of the partition of a row."""
        return F.concat_ws("/", *[F.concat(F.lit(f"{c}="), F.coalesce(F.url_encode(F.col(c).cast("string")), F.lit("__HIVE_DEFAULT_PARTITION__"))) for c in self.by])

    def _generation(self, name: str) -> DataFrame:
        reader = self.spark.read.schema(self.schema) if self.schema else self.spark.read
        return reader.parquet(f"{self.path}/data/{name}")

    def _measured(self, name: str, schema: StructType) -> dict[str, dict]:
        """Files, bytes, rows and sizes of each partition of a generation."""
        fs, p = hadoop_fs(self.spark, f"{self.path}/data/{name}")
        if not fs.exists(p):
            return {}
        one = self.spark.read.schema(schema).parquet(f"{self.path}/data/{name}")
        per_file = one.groupBy(self._key().alias("part"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("size")).agg(F.count("*").alias("rows"))
        out: dict[str, dict] = {}
        for part, power, n, size, rows in per_file.groupBy("part", F.floor(F.log2("size")).alias("power")).agg(F.count("*"), F.sum("size"), F.sum("rows")).collect():
            got = out.setdefault(part, {"files": 0, "bytes": 0, "rows": 0, "sizes": {}})
            got["files"], got["bytes"], got["rows"] = got["files"] + n, got["bytes"] + size, got["rows"] + rows
            got["sizes"][str(power)] = n
        return out

    def _write(self, df: DataFrame) -> tuple[str, dict[str, dict]]:
        """A new generation with the rows of ``df``: (name, its partitions)."""
        name = uuid.uuid4().hex[:16]
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.by).parquet(f"{self.path}/data/{name}")
        self.schema = self.schema or df.schema
        return name, self._measured(name, df.schema)

    def _publish(self, name: str, parts: dict[str, dict], base: Snapshot | None = None, changed: set[str] | None = None, landed: bool = False, settings: dict | None = None) -> Snapshot:
        """Add a generation, in place of all that ``changed`` partitions had in ``base``, as the next snapshot."""
        while True:
            now = self.current()
            for part in changed or ():
                if now.partitions.get(part) != base.partitions.get(part):
                    raise Conflict(f"partition {part} changed between versions {base.version} and {now.version}")
            merged = {k: v for k, v in now.partitions.items() if k not in (changed or ())}
            for part, measured in parts.items():
                merged[part] = {**merged.get(part, {}), name: measured}
            waiting = [*now.landed, *([name] if landed else [])]
            used = {g for gens in merged.values() for g in gens}
            new = Snapshot(now.version + 1, merged, [g for g in waiting if g in used], {**now.settings, **(settings or {})})
            if self._claim(new.version, json.dumps(asdict(new))):
                return new

    def append(self, df: DataFrame, landed: bool = False, settings: dict | None = None) -> Snapshot:
        return self._publish(*self._write(df), landed=landed, settings=settings)

    def read(self, snapshot: Snapshot | None = None, parts: set[str] | None = None) -> DataFrame:
        """The rows of a snapshot (the newest), or of some of its partitions."""
        snapshot = snapshot or self.current()
        by_generation: dict[str, list[str]] = {}
        for part, gens in snapshot.partitions.items():
            if parts is None or part in parts:
                for g in gens:
                    by_generation.setdefault(g, []).append(part)
        # a condition on partition columns only, so files of other partitions are not opened
        found = [self._generation(g).where(self._key().isin(names)) for g, names in sorted(by_generation.items())]
        if not found:
            return self.spark.createDataFrame([], self.schema or StructType([]))
        return reduce(DataFrame.unionByName, found)

    def crowded(self, snapshot: Snapshot, small_bytes: int, min_small: int) -> dict[str, int]:
        """Partitions with at least ``min_small`` files under ``small_bytes`` (by powers of two), and their bytes."""
        small = lambda gens: sum(n for g in gens.values() for power, n in g["sizes"].items() if 2 ** (int(power) + 1) <= small_bytes)
        return {part: sum(g["bytes"] for g in gens.values()) for part, gens in snapshot.partitions.items() if small(gens) >= min_small}

    def compact(self, target_bytes: int = 256 << 20, small_bytes: int | None = None, min_small: int = 8, base: Snapshot | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> Snapshot:
        """Rewrite the crowded partitions, and only these, into files of about target_bytes.

        The partitions are written as a new generation and compared with the
        old files before they are published: rows and the sum of the hashes of
        all rows must agree. Raises Conflict if one of these partitions changed
        since ``base``; the new files are then not part of the table.

        keep: gives the records that stay, with their partition columns
        unchanged and the number of rows each stands for in ``copies``; then the
        partitions with landed generations are rewritten, and the copies must
        add up to those there were.
        """
        base = base or self.current()
        if keep:
            chosen = {part: sum(g["bytes"] for g in gens.values()) for part, gens in base.partitions.items() if set(gens) & set(base.landed)}
        else:
            chosen = self.crowded(base, small_bytes or target_bytes // 4, min_small)
        if not chosen:
            return base
        old = self.read(base, set(chosen))
        new = (keep(old) if keep else old).select(*old.columns)
        n_files = {part: math.ceil(size / target_bytes) for part, size in chosen.items()}
        data = [c for c in old.columns if c not in self.by]
        new = new.withColumn("_part", self._key())
        if max(n_files.values()) > 1:
            wanted = self.spark.createDataFrame(list(n_files.items()), "_part string, _n int")
            new = new.join(broadcast_if_small(wanted), "_part").withColumn("_slot", F.pmod(F.xxhash64(*data), "_n")).drop("_n")
        else:
            new = new.withColumn("_slot", F.lit(0))
        name, parts = self._write(new.repartition(sum(n_files.values()), "_part", "_slot").select(*old.columns))
        weigh = F.sum("copies") if keep else F.struct(F.count("*"), F.sum(F.xxhash64(*data).cast("decimal(20,0)")))
        tally = lambda df: {r[0]: r[1] for r in df.groupBy(self._key()).agg(weigh).collect()}
        if tally(old) != tally(self._generation(name)):
            raise RuntimeError("the rewritten partitions do not hold what they held before")
        return self._publish(name, parts, base, set(chosen))

    def vacuum(self, versions: int = 1) -> list[str]:
        """Remove generations that none of the newest ``versions`` snapshots names, and older snapshots; no writer may be at work."""
        fs, p = hadoop_fs(self.spark, f"{self.path}/data")
        numbers = self._versions()
        used = {g for v in numbers[-versions:] for gens in self.snapshot(v).partitions.values() for g in gens}
        gone = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName() not in used] if fs.exists(p) else []
        for old in gone:
            fs.delete(old, True)
        for v in numbers[:-versions]:
            fs.delete(hadoop_fs(self.spark, f"{self.path}/_snapshots/{v:08d}.json")[1], False)
        return [g.getName() for g in gone]


def consolidate(files: DataFrame, path: str, target_bytes: int = 256 << 20, buckets: int | None = None, min_small: int = 1) -> SnapshotTable:
    """Hold every record of small text files exactly once in few well-sized Parquet files.

    Landing partitions (kind and frame) of at least ``min_small`` small files
    are taken in; those of fewer stay where they are. Their record lines are
    appended as they landed, copies included, and the partitions of the table
    that they fell into, and only these, are rewritten with first copies only.
    Equal records are in one partition, so later deliveries can be consolidated
    into the same table. Records are partitioned by kind and a bucket of the
    record's point; the number of buckets follows from the bytes of the first
    delivery unless given. A frame with very many records is spread over all buckets.
    """
    spark = files.sparkSession
    if min_small > 1:
        crowded = landing_partitions(files).where(F.col("n_small") >= min_small)
        taken = files.withColumns({"_kind": F.col("kind"), "_frame": frame_of()})
        picked = crowded.select(F.col("kind").alias("_kind"), F.col("frame_id").alias("_frame"))
        same = [taken[c].eqNullSafe(picked[c]) for c in ("_kind", "_frame")]
        files = taken.join(broadcast_if_small(picked), same, "left_semi").drop("_kind", "_frame")
    made = SnapshotTable(spark, path, ["kind", "bucket"])
    buckets = made.current().settings.get("buckets") or buckets
    if buckets is None:
        size = files.agg(F.sum(F.octet_length("body").cast("long"))).first()[0] or 0
        buckets = max(1, math.ceil(size / target_bytes))

    def bucketed(records: DataFrame) -> DataFrame:
        return records.withColumn("bucket", F.pmod(F.xxhash64("frame_id", F.col("point_id") + 0.0), F.lit(buckets)).cast("int"))

    landed = bucketed(body_records(files).withColumn("copies", F.lit(1).cast("long")))
    made.schema = landed.schema
    made.arrived = made.append(landed, True, {"buckets": buckets})
    made.compact(target_bytes, base=made.arrived, keep=lambda records: bucketed(unique_records(records)))
    return made


def surplus_of(made: SnapshotTable) -> DataFrame:
    """(file_id, line_no): the record lines that landed last and that the consolidation left out; malformed lines are no records."""
    arrived, name = made.arrived, made.arrived.landed[-1:]
    lines = made.read(Snapshot(partitions={p: {g: m for g, m in gens.items() if g in name} for p, gens in arrived.partitions.items()}))
    lines = lines.where("malformed is null").select("file_id", "line_no")
    return lines.join(made.read().select("file_id", "line_no"), ["file_id", "line_no"], "left_anti")
