"""A hash-bucketed table that is rewritten bucket by bucket and committed by one manifest.

Layout under ``path``::

    data/<commit>/bucket=<k>/*.parquet     files of one commit, never changed
    manifests/<version>.json               for each bucket the folders that hold its rows

A change reads and rewrites the buckets that hold one of its keys; all other
buckets go on pointing to the files they had. The new manifest is written beside
the others and takes its number by a rename that fails where the number is
taken, so of two writers one commits and the other is told (:class:`Conflict`).
A writer that dies leaves files that no manifest names; readers see the version
before, and :meth:`KeyedTable.vacuum` removes them. Older versions can be read.

Defined cases: a null key is a key like any other; of several rows for one key in an
upsert the greatest ``seq`` stays, a null ``seq`` last, and further ties go to
the greatest row; a deleted key that is not there changes nothing, not even the
version; empty changes commit nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer committed the version in between."""


class KeyedTable:
    """Rows by ``key`` in ``buckets`` buckets. ``schema`` is a DDL string or a struct."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str | T.StructType, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)

    # --- manifests -----------------------------------------------------------

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path
        return p(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs()
        found = fs.globStatus(p(f"{self.path}/manifests/*.json")) or []
        return sorted(int(x.getPath().getName().removesuffix(".json")) for x in found)

    def manifest(self, version: int | None = None) -> dict:
        """``version`` and ``folders``: for each bucket (as text) the folders that hold its rows. Version 0 is the empty table."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return {"version": 0, "buckets": self.buckets, "folders": {}}
        fs, p = self._fs()
        stream = fs.open(p(f"{self.path}/manifests/{version}.json"))
        try:
            out = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        if out["buckets"] != self.buckets:
            raise ValueError(f"the table has {out['buckets']} buckets, not {self.buckets}")
        return out

    def _commit(self, before: dict, folders: dict[str, list[str]]) -> int:
        """Make ``folders`` the next version, in one step."""
        version = before["version"] + 1
        fs, p = self._fs()
        fs.mkdirs(p(f"{self.path}/manifests"))
        draft, final = p(f"{self.path}/manifests/.{uuid.uuid4().hex}"), p(f"{self.path}/manifests/{version}.json")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({"version": version, "buckets": self.buckets, "folders": folders}).encode()))
        out.close()
        # a name that is taken: HDFS refuses the rename, other stores may not, so it is looked at first
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise Conflict(f"version {version} of {self.path} is taken")
        return version

    # --- reading -------------------------------------------------------------

    def _paths(self, manifest: dict, buckets: list[int] | None = None) -> list[str]:
        wanted = manifest["folders"].keys() if buckets is None else [str(b) for b in buckets]
        return [f"{self.path}/data/{x}" for b in wanted for x in manifest["folders"].get(b, [])]

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows, of the latest version or an older one."""
        return self._read(self._paths(self.manifest(version)))

    def lookup(self, value) -> DataFrame:
        """The rows of one key: only its bucket is read."""
        row = self.spark.range(1).select(self._bucket(F.lit(value).cast(self.schema[self.key].dataType)).alias("b"))
        return self._read(self._paths(self.manifest(), [row.first()[0]])).where(F.col(self.key).eqNullSafe(F.lit(value)))

    def read_keys(self, keys: DataFrame) -> DataFrame:
        """The rows of all keys whose buckets hold one of ``keys``: other buckets are not read."""
        return self._read(self._paths(self.manifest(), self._touched(keys)))

    # --- writing -------------------------------------------------------------

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Write rows as files of one commit: the folder of each bucket that got any."""
        commit = uuid.uuid4().hex
        at = f"{self.path}/data/{commit}"
        dealt = rows.select(*self.schema.names).withColumn("bucket", self._bucket(F.col(self.key)))
        dealt.repartitionById(self.buckets, "bucket").write.partitionBy("bucket").parquet(at)
        fs, p = self._fs()
        found = fs.globStatus(p(f"{at}/bucket=*")) or []
        names = [x.getPath().getName() for x in found]
        return {n.removeprefix("bucket="): f"{commit}/{n}" for n in names}

    def _touched(self, keys: DataFrame) -> list[int]:
        """Buckets of the keys: at most one number a bucket reaches the driver."""
        return sorted(r[0] for r in keys.select(self._bucket(F.col(self.key)).alias("b")).distinct().collect())

    def append(self, rows: DataFrame) -> int:
        """Add rows; a key may then have several. No bucket is read."""
        before = self.manifest()
        fresh = self._write(rows)
        if not fresh:
            return before["version"]
        folders = {b: list(x) for b, x in before["folders"].items()}
        for b, folder in fresh.items():
            folders.setdefault(b, []).append(folder)
        return self._commit(before, folders)

    def upsert(self, rows: DataFrame, seq: str | None = None) -> int:
        """Rows take the place of what the table holds under their keys; one row a key stays of the batch."""
        names = self.schema.names
        order = F.struct(*([F.col(seq)] if seq else []), F.struct(*names))
        best = rows.groupBy(F.col(self.key)).agg(F.max_by(F.struct(*names), order).alias("_best"))
        batch = best.select(*[F.col(f"_best.{c}").alias(c) for c in names])
        before = self.manifest()
        touched = self._touched(batch)
        if not touched:
            return before["version"]
        held = self._without(self._read(self._paths(before, touched)), batch)
        return self._replace(before, touched, held.unionByName(batch))

    def delete(self, keys: DataFrame) -> int:
        """Rows of these keys go; only buckets that hold one are rewritten."""
        before = self.manifest()
        there = self._read(self._paths(before, self._touched(keys)))
        asked = keys.select(F.col(self.key).alias("_asked")).distinct()
        hit = self._touched(there.select(self.key).join(asked, F.col(self.key).eqNullSafe(F.col("_asked")), "left_semi"))
        if not hit:
            return before["version"]
        return self._replace(before, hit, self._without(self._read(self._paths(before, hit)), keys))

    def replace(self, column: str, values: DataFrame, rows: DataFrame | None = None) -> int:
        """Rows whose ``column`` is among ``values`` go, in whatever buckets they are, and ``rows`` are added, in one commit."""
        before = self.manifest()
        asked = values.select(F.col(column).alias("_asked")).distinct()
        among = F.col(column).eqNullSafe(F.col("_asked"))
        hit = self._touched(self.read(before["version"]).select(self.key, column).join(asked, among, "left_semi"))
        touched = sorted({*hit, *(self._touched(rows) if rows is not None else [])})
        if not touched:
            return before["version"]
        kept = self._read(self._paths(before, touched)).join(asked, among, "left_anti")
        return self._replace(before, touched, kept if rows is None else kept.unionByName(rows.select(*self.schema.names)))

    def overwrite(self, rows: DataFrame) -> int:
        """The table's rows are ``rows`` from now on."""
        before = self.manifest()
        return self._commit(before, {b: [x] for b, x in self._write(rows).items()})

    def _without(self, rows: DataFrame, keys: DataFrame) -> DataFrame:
        asked = keys.select(F.col(self.key).alias("_asked")).distinct()
        return rows.join(asked, F.col(self.key).eqNullSafe(F.col("_asked")), "left_anti")

    def _replace(self, before: dict, touched: list[int], rows: DataFrame) -> int:
        fresh = self._write(rows)
        folders = {b: x for b, x in before["folders"].items() if int(b) not in set(touched)}
        return self._commit(before, folders | {b: [x] for b, x in fresh.items()})

    def vacuum(self, keep: int = 1) -> None:
        """Remove all but the latest ``keep`` versions and every file that none of them names. Not to be run beside a writer."""
        fs, p = self._fs()
        versions = self.versions()
        kept = versions[-keep:] if keep else []
        named = {x.split("/")[0] for v in kept for xs in self.manifest(v)["folders"].values() for x in xs}
        for v in versions:
            if v not in kept:
                fs.delete(p(f"{self.path}/manifests/{v}.json"), False)
        for x in fs.globStatus(p(f"{self.path}/data/*")) or []:
            if x.getPath().getName() not in named:
                fs.delete(x.getPath(), True)
