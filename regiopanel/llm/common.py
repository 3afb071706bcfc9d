"""Helpers shared by the training-data operators: staged tables in the shared
folder, word and hash helpers, shared-key filtering, connected components."""

from __future__ import annotations

import math
import sys
import types
import uuid
from contextlib import contextmanager

import numpy as np
import pandas as pd
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regiopanel.session import ensure_checkpoint_dir

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder (not yet created)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _shuffle_cleanup(spark: SparkSession):
    """Shuffle files of the executions inside are removed as each one ends: the
    staged table that it wrote replaces them."""
    old = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, old) if old is not None else spark.conf.unset(_CLEANUP)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is
    cut, and a lost executor costs only the tasks of the running stage."""
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    with _shuffle_cleanup(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Remove a staged table that nothing reads any more."""
    spark = df.sparkSession
    for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(root)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fresh_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores added until no column of ``df`` has the name
    (column names are compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def numbered_rows(docs: DataFrame, row: str) -> DataFrame:
    """``docs`` with a number for each row that every later reading of it gives again.

    Rows of a plain reading of Parquet files go by their file's number, in the order of
    the names, and their place in it, so nothing is copied.  Other frames are numbered in
    a staged copy."""
    plan = analysed = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() == "Project":
        plan = plan.child()
    if plan.nodeName() != "LogicalRelation" or not analysed.deterministic() or "_metadata" in {c.lower() for c in docs.columns}:
        return stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    file, at = fresh_name(docs, "file_"), fresh_name(docs, "at_")
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(at))
    except AnalysisException:  # files of another format, without places
        return stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    files = placed.select(file).distinct()
    number = F.row_number().over(Window.orderBy(file)) - 1  # one row per file
    numbers = stage(files.select(file, (number.cast("long") * (1 << 40)).alias(row)), "file-numbers")
    return placed.join(small_enough(numbers), file).withColumn(row, F.col(row) + F.col(at)).drop(file, at)


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; bytes.lower and
    bytes.split work on exactly those ASCII characters."""
    return text.encode().lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w) for w in words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, vectorised."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Order-dependent 64-bit hashes of the n-grams of a word-hash array (empty
    for fewer than ``n`` words)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i:i + m] + np.uint64(i + 1))
    return out


def connected_components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) for every node of the undirected ``edges(a, b)``;
    component is the smallest node that can be reached.

    Each round hooks every label to its smallest neighbour, follows those
    pointers to their ends by doubling, and contracts the edges to the labels
    left, so a path of any length takes a logarithmic number of rounds.  All
    state is in staged tables; only counts reach the driver.
    """
    e = edges.select("a", "b").where("a <> b")
    nodes = e.select(F.col("a").alias("node")).union(e.select(F.col("b").alias("node"))).distinct()
    labels = stage(nodes.select("node", F.col("node").alias("component")), "cc-labels")
    live = stage(e.distinct(), "cc-edges")
    for _ in range(rounds):
        if live.isEmpty():
            return labels
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("m")) \
            .select("x", F.least("x", "m").alias("p"))
        up = stage(up, "cc-up")
        while True:
            hop = up.select(F.col("x").alias("p"), F.col("p").alias("q"))
            nxt = stage(up.join(hop, "p").select("x", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "cc-up")
            drop_stage(up)
            up = nxt.select("x", "p")
            if not nxt.where("moved").limit(1).count():
                break
        to = up.select(F.col("x").alias("component"), F.col("p").alias("top"))
        new_labels = stage(labels.join(to, "component", "left")
                           .select("node", F.coalesce("top", "component").alias("component")), "cc-labels")
        a = up.select(F.col("x").alias("a"), F.col("p").alias("pa"))
        b = up.select(F.col("x").alias("b"), F.col("p").alias("pb"))
        new_live = stage(live.join(a, "a").join(b, "b").where("pa <> pb")
                         .select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "cc-edges")
        for old in (labels, live, up):
            drop_stage(old)
        labels, live = new_labels, new_live
    raise RuntimeError("connected components did not converge")


def small_enough(df: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """``df``, a staged table of a few numbers a row, marked for broadcast only while
    it has at most ``most_rows`` rows; beyond that the join is shuffled as usual."""
    return F.broadcast(df) if df.count() <= most_rows else df


def tree_sum(parts: DataFrame, tasks: int, most: int = 64) -> np.ndarray | None:
    """The sum of float64 arrays (part long, data binary), one per task, added up in a
    tree: nobody receives more than about the square root of the tasks, the driver at
    most ``most`` arrays.  None without any."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.float64) for x in frame.sort_values("part")["data"])
        return pd.DataFrame({"part": [int(frame["part"].iloc[0])], "data": [total.tobytes()]})

    while tasks > most:
        tasks = math.isqrt(tasks - 1) + 1
        parts = parts.groupBy(F.pmod("part", F.lit(tasks)).alias("g")).applyInPandas(add, "part long, data binary")
    got = sorted((r.part, bytes(r.data)) for r in parts.collect())
    return sum(np.frombuffer(x, np.float64) for _, x in got) if got else None


def kept_in_worker(key: str, make):
    """``make()``, once in the life of a Python worker.  Functions of this folder reach
    the workers by value, so a module of its own holds what tasks share."""
    shared = sys.modules.setdefault("regiopanel_worker_objects", types.ModuleType("regiopanel_worker_objects"))
    if not hasattr(shared, key):
        setattr(shared, key, make())
    return getattr(shared, key)


def id_text(id_col: str) -> F.Column:
    """An id as text, for its way through pandas, where a long column with nulls
    would turn into floats; cast it back to long behind."""
    return F.col(id_col).cast("long").cast("string").alias("doc_id")


def long_id(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.col("doc_id").cast("long"))


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows, so that a batch of long texts
    stays small in a Python worker; a setting of the user's is kept."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))
