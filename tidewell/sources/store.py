"""The chunk table: versioned Parquet with replace-by-path writes that touch only the buckets of the written paths.

Layout: data/v=<n>/bucket=<b>/ holds buckets as version n wrote them; manifest/v=<n>/ lists for each bucket the version that
holds it. A version exists once its manifest is committed (_SUCCESS), so a writer that dies leaves the last one in force and
readers keep the version they opened. Paths may be on any store that Spark writes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.text import chunk_id

CHUNK_SCHEMA = "id string, path string, section string, text string, vector array<float>, mtime long, ordinal int"
META_SCHEMA = "key string, value string"


class DimensionError(ValueError):
    """Vectors of another length than the table's."""


@dataclass
class ChunkStore:
    """fresh: every read looks for the newest version; else the version seen first is kept until this store writes."""

    spark: SparkSession
    root: str
    buckets: int = 64
    fresh: bool = True
    _pinned: int | None = field(default=None, repr=False)

    # --- versions ---
    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _versions(self, kind: str) -> list[int]:
        fs, p = self._fs(f"{self.root}/{kind}")
        if not fs.exists(p):
            return []
        found = []
        for s in fs.listStatus(p):
            name = s.getPath().getName()
            if name.startswith("v=") and fs.exists(self._fs(f"{self.root}/{kind}/{name}/_SUCCESS")[1]):
                found.append(int(name[2:]))
        return sorted(found)

    def version(self) -> int:
        """0 if there is no table yet."""
        if self.fresh or self._pinned is None:
            self._pinned = max(self._versions("manifest"), default=0)
        return self._pinned

    def _manifest(self, version: int) -> dict[int, int]:
        if not version:
            return {}
        return {r["bucket"]: r["v"] for r in self.spark.read.schema("bucket int, v int, dim int").parquet(f"{self.root}/manifest/v={version}").collect()}

    def dimension(self) -> int | None:
        v = self.version()
        row = self.spark.read.schema("bucket int, v int, dim int").parquet(f"{self.root}/manifest/v={v}").first() if v else None
        return row["dim"] if row else None

    # --- reads ---
    def chunks(self, buckets: list[int] | None = None) -> DataFrame:
        manifest = self._manifest(self.version())
        paths = [f"{self.root}/data/v={v}/bucket={b}" for b, v in sorted(manifest.items()) if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], CHUNK_SCHEMA)
        return self.spark.read.schema(CHUNK_SCHEMA).parquet(*paths)

    def buckets_of(self, paths: DataFrame) -> list[int]:
        """The buckets of the paths (a DataFrame with path): `buckets` numbers at most."""
        return sorted(r["b"] for r in paths.select(self._bucket().alias("b")).distinct().collect())

    def count(self) -> int:
        return self.chunks().count()

    def paths(self) -> DataFrame:
        """path, mtime: one row per file."""
        return latest_paths(self.chunks())

    def meta(self) -> dict[str, str]:
        versions = self._versions("meta")
        if not versions:
            return {}
        return {r["key"]: r["value"] for r in self.spark.read.schema(META_SCHEMA).parquet(f"{self.root}/meta/v={versions[-1]}").collect()}

    # --- writes ---
    def _bucket(self, path="path"):
        return F.pmod(F.xxhash64(path), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, version: int, mode: str) -> None:
        # several tasks share a bucket where there are more tasks than buckets
        spread = int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets + 1
        rows = rows.withColumn("bucket", self._bucket()).repartition("bucket", F.pmod(F.xxhash64("path", "ordinal"), F.lit(spread)))
        rows.write.mode(mode).partitionBy("bucket").parquet(f"{self.root}/data/v={version}")

    def _written(self, version: int) -> list[int]:
        fs, p = self._fs(f"{self.root}/data/v={version}")
        return sorted(int(s.getPath().getName()[7:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("bucket=")) if fs.exists(p) else []

    def _commit(self, last: int, touched: list[int], dim: int | None) -> None:
        new, manifest = last + 1, {b: v for b, v in self._manifest(last).items() if b not in touched}
        listed = [(b, v, dim) for b, v in {**manifest, **dict.fromkeys(self._written(new), new)}.items()]
        self.spark.createDataFrame(listed, "bucket int, v int, dim int").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/v={new}")
        self._pinned = new

    def upsert(self, chunks: DataFrame) -> None:
        """Replaces all chunks of the paths in chunks (path, section, text, vector, mtime, ordinal). Without rows nothing
        happens. All vectors must be as long as the table's. The rows are written first, which computes their vectors once;
        what is checked, and joined with the old rows of their buckets, is what was written."""
        chunks = chunks.select(chunk_id("path", "ordinal").alias("id"), "path", F.coalesce("section", F.lit("")).alias("section"), "text", "vector", F.col("mtime").cast("long").alias("mtime"), F.col("ordinal").cast("int").alias("ordinal"))
        self._pinned = None
        last = self.version()
        known, target = self.dimension(), f"{self.root}/data/v={last + 1}"
        self._write(chunks, last + 1, "overwrite")
        touched = self._written(last + 1)
        if not touched:
            return
        new = self.spark.read.schema(CHUNK_SCHEMA).parquet(*[f"{target}/bucket={b}" for b in touched])
        shortest, longest = new.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
        if shortest != longest or shortest < 1 or known not in (None, shortest):
            fs, p = self._fs(target)
            fs.delete(p, True)
            raise DimensionError(f"vectors of {shortest} to {longest} numbers; the table has {known}")
        old = self.chunks(touched)
        self._write(old.join(new.select("path").distinct(), "path", "left_anti").select(*old.columns), last + 1, "append")
        self._commit(last, touched, shortest)

    def delete(self, paths: DataFrame) -> None:
        """Removes all chunks of the paths (a DataFrame with path)."""
        touched = self.buckets_of(paths)
        self._pinned = None
        last = self.version()
        if touched and last:
            dim = self.dimension()
            self._write(delete_by_path(self.chunks(touched), paths), last + 1, "overwrite")
            self._commit(last, touched, dim)

    def set_meta(self, values: dict[str, str]) -> None:
        new = max(self._versions("meta"), default=0) + 1
        self.spark.createDataFrame(sorted(values.items()), META_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/meta/v={new}")

    def reset(self) -> None:
        """Drops all chunks, their dimension and the meta values."""
        for kind in ("manifest", "meta", "data"):
            fs, p = self._fs(f"{self.root}/{kind}")
            fs.delete(p, True)
        self._pinned = None


#: Stores by name; add your own with the same methods.
STORES: dict[str, Callable[[SparkSession, str], ChunkStore]] = {"parquet": ChunkStore}


def latest_paths(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("path").agg(F.max("mtime").alias("mtime"))


def replace_by_path(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new.select("path").distinct(), "path", "left_anti").select(*old.columns).unionByName(new)


def delete_by_path(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    return chunks.join(paths.select("path").distinct(), "path", "left_anti").select(*chunks.columns)
