"""What the operators of this subpackage share: work tables, row keys, components."""

from __future__ import annotations

import ctypes
import itertools
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_own_roots: dict[str, str] = {}


def work_root(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; a folder of our own only where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        app = spark.sparkContext.applicationId
        if app not in _own_roots:
            _own_roots[app] = "file://" + tempfile.mkdtemp(prefix="splitaudit-work-")
        root = _own_roots[app]
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def rename(spark: SparkSession, path: str, old: str, new: str) -> None:
    """Files of a folder that end in `old` end in `new` instead."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in system.listStatus(folder):
        file = status.getPath()
        if file.getName().endswith(old):
            to = spark._jvm.org.apache.hadoop.fs.Path(folder, file.getName()[: -len(old)] + new)
            if not system.rename(file, to):
                raise OSError(f"{file} could not be renamed")


def cut(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: its lineage ends there and it is computed once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in itertools.chain([name], (f"{name}_{i}" for i in itertools.count(1))) if n.lower() not in taken)


def new_column(df: DataFrame, name: str | None, default: str) -> str:
    """The name of a column to add: a free one by default; one that `df` has already is an error."""
    if name is None:
        return fresh(df, default)
    if name.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"the documents already have a column {name}")
    return name


def release() -> None:
    """Give freed memory back to the system: a Python worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: it keeps what it keeps


def tidy(fn):
    """A function for mapInArrow that leaves no freed memory with the worker."""

    def run(batches):
        yield from fn(batches)
        release()

    return run


def texts_of(batch: pa.RecordBatch, column: int | str) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(column: Column, m: int) -> Column:
    """crc32 of an id's text, modulo m: the fold that the query contracts name."""
    return F.crc32(column.cast("string").cast("binary")) % m


#: Edges that a task of a round takes at least, where there are more than a few tasks.
TASK_EDGES = 50_000


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 40) -> DataFrame:
    """Connected components of an edge list: (node, component), component the smallest node.

    Alternating large-star and small-star rounds.  Both stars use a minimum (combined
    before the shuffle) and an equi-join, so no node's neighbours are ever gathered in one
    place and a hub's join partition can be split.  Each round is cut to the shared folder;
    the driver sees one count and checksum a round.  `edges` is computed once, so callers need not cut it.  Self-loops and nulls are ignored; an
    empty edge list gives an empty result; repeated edges count once.
    """
    spark = edges.sparkSession
    kind = edges.schema[a].dataType
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    path = new_path(spark, "edges")
    pairs.write.parquet(path)
    schema = T.StructType([T.StructField("u", kind), T.StructField("v", kind)])
    state = None
    for _ in range(max_rounds):
        e = spark.read.schema(schema).parquet(path)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if now == state or not now[0]:
            break
        state = now
        tasks = max(8, now[0] // TASK_EDGES)  # a short list is not dealt over more tasks than it fills
        few = lambda df: df.coalesce(tasks)  # noqa: E731, B023
        e = few(e)
        both = e.union(e.select("v", "u"))  # large star: greater neighbours move to the least neighbour
        least = few(both.groupBy(F.col("u").alias("k")).agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = few(both.where("v > u").join(least, F.col("u") == F.col("k"))).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = few(large.where("u <> v").distinct())
        low = few(large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")))  # small star
        joined = few(large.join(low, F.col("u") == F.col("k")))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        old, path = path, new_path(spark, "edges")
        few(small.where("u <> v").distinct()).write.parquet(path)
        drop_path(spark, old)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = spark.read.schema(schema).parquet(path)
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select(F.col("v"), F.col("v"))).distinct()
