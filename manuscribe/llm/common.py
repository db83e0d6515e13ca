"""What the training-data operators share: stored intermediates, checked broadcasts, components."""

from __future__ import annotations

import contextlib
import ctypes
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType

#: Used only where a local session names no shared folder, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/manuscribe"

#: A side of a join is broadcast up to this many rows and bytes, and shuffled beyond.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 96 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A session on one machine may do without; a cluster may not."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        where = LOCAL_CHECKPOINTS
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


class Scratch:
    """Tables of one operator's run below the shared folder.

    Each is written once by Spark's committer and read back, so that a lost
    executor costs a re-read, never the lineage before the table. Results are
    read from these tables, so the folder goes when the session's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/manuscribe-{name}-{uuid.uuid4().hex}"
        self._n = 0
        fs, path = self._at(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _at(self, where: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def path(self, tag: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{tag}"

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        """Write df and return the stored table."""
        path = self.path(tag)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stored_at = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing will read again."""
        path = getattr(df, "_stored_at", None)
        if path:
            fs, p = self._at(path)
            fs.delete(p, True)


def _bytes(c: Column, kind: DataType) -> Column:
    """About what a value takes."""
    if isinstance(kind, StringType | BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        return F.coalesce(F.size(c), F.lit(0)) * (8 if kind.elementType.typeName() in ("long", "double", "integer") else 32) + 16
    return F.lit(16)


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows and bytes, counted, are few; df itself (a shuffled join) if not."""
    each = sum((_bytes(F.col(f.name), f.dataType) for f in df.schema), F.lit(0))
    n, size = df.select(each.alias("b")).limit(rows + 1).agg(F.count("*"), F.sum("b")).first()
    return F.broadcast(df) if n <= rows and (size or 0) <= most_bytes else df


def least_overlap(k: int, similarity: float, miss: float = 1e-8) -> int:
    """Largest c with P(Binomial(k, similarity) < c) <= miss.

    Of the k smallest hash values of a union, a pair at this Jaccard similarity
    shares at least c, but for a chance of `miss`.
    """
    below, c = 0.0, 0
    for i in range(k + 1):
        below += math.comb(k, i) * similarity**i * (1 - similarity) ** (k - i)
        if below > miss:
            break
        c = i + 1
    return c


def components(scratch: Scratch, edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, comp): the smallest id that each node of `edges` reaches; nodes without edges are absent.

    Minimum labels travel along edges and then jump through the label's own
    label, so rounds grow with the logarithm of a path's length in practice.
    Aggregates are partial before each shuffle; labels are a stored table in
    every round.
    """
    both = scratch.keep(
        edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
        .union(edges.select(F.col(b).alias("x"), F.col(a).alias("y")))
        .filter("x <> y")
        .distinct(),
        "both-ways",
    )
    label = scratch.keep(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("comp")).select(F.col("x").alias("node"), "comp"), "labels")
    for _ in range(most_rounds):
        near = both.join(label.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("comp").alias("m"))
        step = label.join(near.withColumnRenamed("x", "node"), "node").select("node", F.least("comp", "m").alias("comp"), F.col("comp").alias("was"))
        step = scratch.keep(step, "step")
        jump = step.alias("s").join(step.select(F.col("node").alias("via"), F.col("comp").alias("further")), F.col("s.comp") == F.col("via"), "left")
        new = scratch.keep(jump.select("node", F.least("comp", F.coalesce("further", "comp")).alias("comp"), "was"), "labels")
        changed = new.filter("comp <> was").limit(1).count()
        scratch.drop(step)
        scratch.drop(label)
        label = new
        if not changed:
            return label.select("node", "comp")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df does not have, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def groups_of(table: pa.Table, *names: str) -> Iterator[tuple[tuple, pa.Table]]:
    """Parts of a table with equal values of the named long columns."""
    table = table.sort_by([(n, "ascending") for n in names])
    cols = [table[n].to_numpy() for n in names]
    cut = np.zeros(len(table), bool)
    cut[:1] = True
    for c in cols:
        cut[1:] |= c[1:] != c[:-1]
    at = np.append(np.flatnonzero(cut), len(table))
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield tuple(c[lo] for c in cols), table.slice(lo, hi - lo)


def joined(ids: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one group's symmetric links: each row's pair with the smallest id that its links reach in the group."""
    has = np.flatnonzero(linked.any(axis=1))
    has = has[np.argsort(ids[has], kind="stable")]
    near = linked[np.ix_(has, has)]
    label = np.arange(len(has))
    while len(has):
        new = np.minimum(label, np.where(near, label[None, :], len(has)).min(axis=1))
        new = new[new]
        if (new == label).all():
            break
        label = new
    rest = np.flatnonzero(label != np.arange(len(has)))
    return ids[has[rest]], ids[has[label[rest]]]


def hand_back() -> None:
    """Return freed memory to the system, as idle workers keep it else."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable) -> Callable:
    """An Arrow function whose worker hands memory back after each batch it gives out."""

    def wrapped(batches):
        for out in run(batches):
            yield out
            hand_back()

    return wrapped


def crc_of_id(c: Column) -> Column:
    """crc32 of an id's decimal text."""
    return F.crc32(c.cast("string"))
