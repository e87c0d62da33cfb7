"""What several text operators share: tables, intermediate results in shared storage, values kept by a
Python worker, union-find over the links of one task, and connected components over DataFrames."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schema_with(df: DataFrame, **more: T.DataType) -> T.StructType:
    """The columns of ``df`` and more."""
    return T.StructType([*df.schema.fields, *(T.StructField(name, kind) for name, kind in more.items())])


def fresh(taken: Iterable[str], *names: str) -> tuple[str, ...]:
    """``names``, each with as many underscores in front as keep it apart from those taken, whatever the case."""
    held, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        out.append(name)
    return tuple(out)


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local session without it gets one of its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in shared storage: its lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table made by ``written`` that nothing reads any more."""
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/table-" not in name:
            raise ValueError(f"{name} was not made by written()")
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of texts that go to a Python worker at a time; Spark's own limits are 10,000 rows and 64 MB, held by the JVM and the worker at once.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches to Python workers hold ``BATCH_BYTES`` or one row, unless the session has a limit of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def sliced(batches: Iterable, rows: int = 512) -> Iterator:
    """Arrow batches in parts of at most ``rows`` rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def trimmed() -> None:
    """Gives the memory that this process has freed back to the system; else a worker keeps what its largest task took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim is not None:
        trim(0)


def worker_of(operator: str) -> dict:
    """What ``operator`` keeps in this Python worker process for its later tasks; what other operators kept goes, its memory too.

    Functions are sent to executors with their code, so their module variables last for one task only.
    """
    home = sys.modules.setdefault("_evalpanel_kept", types.ModuleType("_evalpanel_kept"))
    if getattr(home, "operator", None) != operator:
        home.operator, home.values = operator, {}
        trimmed()
    return home.values


def per_worker(operator: str, key: object, build: Callable[[], object], version: object = None) -> object:
    """A value of ``operator`` built once in a worker and kept until another version, or another operator, is asked for."""
    kept = worker_of(operator)
    if key not in kept or kept[key][0] != version:
        kept.pop(key, None)  # the old version goes before the new one is built
        kept[key] = version, build()
    return kept[key][1]


class Memo:
    """A mapping of bounded size: when the young half is full, it becomes the old half and the old half goes."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def fill(self, keys: Iterable, compute: Callable[[list], list]) -> dict:
        """The young half, holding all of ``keys``; missing ones are computed together."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing = [k for k in keys if k not in young]
        if missing and old:
            young.update((k, old[k]) for k in missing if k in old)
            missing = [k for k in missing if k not in old]
        if missing:
            young.update(zip(missing, compute(missing)))
        return young


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a[i], b[i]) reduced to one link from each node to the smallest node it reaches through them."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        low = np.minimum(rx, ry)
        before = root.copy()
        np.minimum.at(root, rx, low)
        np.minimum.at(root, ry, low)
        while not np.array_equal(root, jumped := root[root]):
            root = jumped
        if np.array_equal(before, root):
            break
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the links (a[i], b[i]) that are enough to join what all of them join: every group takes its first link outward, again and again."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root, kept = np.arange(len(nodes)), np.zeros(len(a), bool)
    while True:
        open_ = np.flatnonzero(root[x] != root[y])
        if not len(open_):
            return a[kept], b[kept]
        first = np.full(len(nodes), len(a))
        np.minimum.at(first, root[x[open_]], open_)
        np.minimum.at(first, root[y[open_]], open_)
        taken = np.unique(first[first < len(a)])
        kept[taken] = True
        far, low = forest(root[x[taken]], root[y[taken]])
        to = np.arange(len(nodes))
        to[far] = low
        root = to[root]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node of a link with the smallest node it reaches. Unlinked nodes do not appear.

    Alternates large and small stars: every node hands its larger neighbours, then its smaller ones, to the smallest
    neighbour, until all links form stars. A round is two shuffles of at most two rows per link, and the number of rounds
    grows with the logarithm of the longest path. Neighbourhoods are windows, which spill, and never leave Spark.
    """
    spark = edges.sparkSession
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    now, mark = written(ends), None
    by_u = W.partitionBy("u")
    while True:
        both = now.union(now.select("v", "u"))
        large = (
            both.withColumn("m", F.least(F.min("v").over(by_u), "u")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        low = large.withColumn("m", F.min("v").over(by_u))
        small = low.select("u", F.col("m").alias("v")).union(low.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        new = written(small)
        found = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now = new
        if tuple(found) == mark:
            break
        mark = tuple(found)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
