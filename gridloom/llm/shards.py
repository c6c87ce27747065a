"""Size-tiered shards under a versioned manifest.

Rows arrive as small immutable Parquet shards. Shards of a similar size form a
tier; when a tier has enough of them they are merged, without a shuffle, into
files of the target size. Each append or compaction commits a new version of
the manifest by one rename that fails if the version exists, so a reader sees
all of a change or nothing, and files that no manifest names are not data.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of an arriving shard at most; below that it holds what one task writes.
ARRIVAL_ROWS = 100_000
#: Bytes of a merged shard, about; shards from half of it on stay as they are.
TARGET_BYTES = 32 << 20
#: Shards of a tier that call for a merge, and the factor from one tier to the next.
FAN_IN = 4
TIER_FACTOR = 4
#: Shards that one job merges at most, and so names that the driver holds then.
MERGE_SHARDS = 10_000
#: Rows of a file of the manifest.
MANIFEST_ROWS = 500_000
_CODEC = "zstd"
_MANIFEST = "shard string, rows long, bytes long"


def tier_of(size: str, target: int) -> Column:
    """0 for sizes below half the target, more for each TIER_FACTOR below; null from half on."""
    steps = F.floor(F.log(F.lit(target / 2) / F.greatest(F.col(size), F.lit(1))) / F.log(F.lit(float(TIER_FACTOR))))
    return F.when(F.col(size) >= target / 2, F.lit(None)).otherwise(F.greatest(steps, F.lit(0))).cast("int")


class ConcurrentCommit(RuntimeError):
    """Another writer committed the version first."""


class ShardStore:
    """A table of shards in one folder of any Hadoop file system.

    The manifest has a row (shard, rows, bytes) for each live shard. An empty
    arrival commits a version without new shards. Columns, nulls and repeated
    rows are kept as they come; an arrival of other columns or types than the
    shards have is refused.
    """

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES):
        self.spark, self.root, self.target = spark, root.rstrip("/"), target_bytes
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._schema: StructType | None = None

    # -- versions

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The latest committed version, 0 before any."""
        fs, folder = self._files(), self._path("manifests")
        if not fs.exists(folder):
            return 0
        return max((int(s.getPath().getName()[1:]) for s in fs.listStatus(folder)), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifests/v{version:08d}")

    def _commit(self, manifest: DataFrame, version: int) -> int:
        staged = f"staging/{uuid.uuid4().hex}"
        manifest.coalesce(1).write.option("maxRecordsPerFile", MANIFEST_ROWS).parquet(f"{self.root}/{staged}")
        self._files().mkdirs(self._path("manifests"))
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        context = self._hadoop.FileContext.getFileContext(self._path("").toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        final = self._path(f"manifests/v{version:08d}")
        if self._files().exists(final):
            raise ConcurrentCommit(f"version {version} exists")
        try:
            context.rename(self._path(staged), final, none)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise ConcurrentCommit(f"version {version} exists") from e
            raise
        return version

    # -- shards

    def _written(self, folder: str, schema) -> DataFrame:
        """Manifest rows of the files in a folder; none if no file has rows."""
        files = self.spark.read.schema(schema).parquet(folder)
        found = files.select(F.col("_metadata.file_path").alias("shard"), F.col("_metadata.file_size").alias("bytes"))
        return found.groupBy("shard", "bytes").agg(F.count("*").alias("rows")).select("shard", "rows", "bytes")

    def schema(self, live: DataFrame) -> StructType | None:
        """The schema of the shards, read once; None without any."""
        if self._schema is None and (one := live.select("shard").first()):
            self._schema = self.spark.read.parquet(one.shard).schema
        return self._schema

    def append(self, df: DataFrame) -> int:
        """Writes ``df`` as small shards and commits them; the new version."""
        before = self.version()
        live = self.manifest(before)
        held = self.schema(live) or df.schema
        kinds = lambda schema: [(f.name, f.dataType.simpleString()) for f in schema]
        if kinds(held) != kinds(df.schema):
            raise ValueError(f"the shards have {held.simpleString()}, not {df.schema.simpleString()}")
        folder = f"{self.root}/data/a{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", ARRIVAL_ROWS).option("compression", _CODEC).parquet(folder)
        return self._commit(live.unionByName(self._written(folder, df.schema)), before + 1)

    def compact(self) -> int:
        """Merges tiers until none has FAN_IN shards, and commits; the version then.

        Without a tier to merge there is no new version. A job merges
        MERGE_SHARDS of a tier at most; the plan itself stays a table.
        """
        before = self.version()
        live, staged = self.manifest(before), ""
        while True:
            tiers = live.withColumn("tier", tier_of("bytes", self.target)).where("tier IS NOT NULL")
            full = tiers.groupBy("tier").count().where(F.col("count") >= FAN_IN).orderBy(F.desc("tier")).first()
            if not full:
                break
            # The shards of earlier runs first, by their names, so that a plan made again is the same.
            merged = tiers.where(F.col("tier") == full.tier).orderBy("bytes", "shard").limit(MERGE_SHARDS)
            chosen = merged.select("shard", "bytes").collect()
            read = self.spark.read.schema(self.schema(live)).parquet(*(r.shard for r in chosen))
            folder = f"{self.root}/data/c{uuid.uuid4().hex}"
            files = max(1, round(sum(r.bytes for r in chosen) / self.target))
            read.coalesce(files).write.option("compression", _CODEC).parquet(folder)
            rest = live.join(merged.select("shard"), "shard", "left_anti")
            last, staged = staged, f"{self.root}/staging/{uuid.uuid4().hex}"
            rest.unionByName(self._written(folder, read.schema)).write.parquet(staged)
            live = self.spark.read.schema(_MANIFEST).parquet(staged)
            self._drop(last)
        if not staged:
            return before
        version = self._commit(live, before + 1)
        self._drop(staged)
        return version

    def _drop(self, path: str) -> None:
        if path:
            self._files().delete(self._hadoop.Path(path), True)

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows of a version, with its hidden ``_metadata`` columns; None if it has none.

        The driver holds the name of each shard, as Spark's own list of a table's files does.
        """
        live = self.manifest(version)
        paths = [r.shard for r in live.select("shard").toLocalIterator()]
        return self.spark.read.schema(self.schema(live)).parquet(*paths) if paths else None

    def vacuum(self, keep: int = 1) -> int:
        """Deletes data files that none of the last ``keep`` versions names; how many.

        Folders are gone through one after another; of each the driver holds the names.
        """
        last = self.version()
        versions = [f"{self.root}/manifests/v{v:08d}" for v in range(max(1, last - keep + 1), last + 1)]
        live = self.spark.read.parquet(*versions).select(F.substring_index(F.col("shard"), "/data/", -1).alias("shard")).distinct()
        counts = {r["folder"]: r["count"] for r in live.groupBy(F.substring_index("shard", "/", 1).alias("folder")).count().collect()}
        fs, gone = self._files(), 0
        for folder in (x.getPath() for x in fs.listStatus(self._path("data"))):
            name = folder.getName()
            files = [x.getPath() for x in fs.listStatus(folder) if x.getPath().getName().endswith(".parquet")]
            if not counts.get(name):
                gone += len(files)
                fs.delete(folder, True)
            elif counts[name] < len(files):
                held = {r.shard for r in live.where(F.col("shard").startswith(f"{name}/")).collect()}
                gone += sum(bool(fs.delete(f, False)) for f in files if f"{name}/{f.getName()}" not in held)
        return gone
