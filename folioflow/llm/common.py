"""Helpers shared by the corpus operators: tables, scratch space, text columns."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_scratch: dict[str, str] = {}
#: Tables that are still there, with their session.
_written: dict[str, SparkSession] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text column as a string, null read as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def doc_texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the whole ``text`` (null: empty); every other column is pruned from the scan."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a folder of our own (one machine) or the warehouse."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    if not spark.sparkContext.master.startswith("local"):
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    app = spark.sparkContext.applicationId
    if app not in _own_scratch:
        _own_scratch[app] = tempfile.mkdtemp(prefix="scratch-")
        spark.sparkContext.setCheckpointDir(_own_scratch[app])
    return _own_scratch[app]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone; the folder's owner clears it
        pass


#: Removes the shuffle files of a query when it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    A written table survives the loss of any executor. :func:`discard` removes
    it; what is left goes when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def owned(spark: SparkSession, path: str) -> str:
    """A folder of this driver's own, named after ``path``; it goes like the tables of :func:`materialise`."""
    path = f"{path}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


@atexit.register
def _clear() -> None:
    for path, spark in _written.items():
        _delete(spark, path)


def discard(df: DataFrame) -> None:
    """Remove the table that :func:`materialise` wrote for ``df``, once nothing reads it any more."""
    path = getattr(df, "_written_path", None)
    if path in _written:
        _delete(_written.pop(path), path)


def spread_by(df: DataFrame, key: str, *aggregates: Column) -> DataFrame:
    """``df`` aggregated by ``key``, grouped by a second expression of it as well.

    A join on the key then gets exchanges of its own on both sides, which
    adaptive execution can split where one key holds a large share of the rows.
    """
    return df.groupBy(key, F.pmod(F.hash(key), F.lit(1 << 16)).alias("_cell")).agg(*aggregates).drop("_cell")


def in_cells(tables: DataFrame, slices: DataFrame, salts: list[int], spread: str) -> DataFrame:
    """Every row of ``slices`` in one task with all rows of ``tables`` that have its ``block``.

    Both sides have the same columns and ``block``, 0 up to the number of salts. Block b is dealt to
    ``salts[b]`` cells: its slices by the hash of ``spread``, its table rows to
    each of them. A cell is one task, which reads its table rows before its
    slices (column ``is_slice``). Nothing goes through the driver.
    """
    first, total = [], 0
    for n in salts:
        first.append(total)
        total += n
    numbers = lambda xs: F.element_at(F.array(*map(F.lit, xs)), F.col("block").cast("int") + 1)
    begin, width = numbers(first), numbers(salts)
    copies = tables.withColumn("cell", F.explode(F.sequence(begin, begin + width - 1))).withColumn("is_slice", F.lit(False))
    dealt = slices.withColumn("cell", begin + F.pmod(F.xxhash64(spread), width).cast("int")).withColumn("is_slice", F.lit(True))
    return copies.unionByName(dealt).repartitionById(total, "cell").sortWithinPartitions("cell", "is_slice")


def spans_digest(spans: Column) -> Column:
    """array<struct<s, k, e, kind>> sorted by start, then kind: ``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def free_name(df: DataFrame, want: str) -> str:
    """``want``, lengthened until no column of ``df`` has that name (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while want.lower() in taken:
        want += "_"
    return want
