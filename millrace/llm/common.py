"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.deal import join_hot

#: Rows that a Python worker gets at a time: with whole texts in them, batches of the default size take hundreds of MB.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
#: Whether a write's shuffles go as it ends, and not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a table that one file or two may hold and that is dealt over all cores before Python reads it.
SMALL = 64 << 20
#: Buckets of a rank: their least number, and the rows that one aims at.
LEAST_BUCKETS, BUCKET_ROWS = 32, 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only a local master may go without the setting: one machine holds all tasks then.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


_lock = threading.RLock()
_writers = 0
_before: dict[str, str] = {}
#: Paths of the steps that are still there, with the session that wrote them, and the scopes that watch new ones.
_steps: dict[str, SparkSession] = {}
_scopes: list[list[str]] = []


@contextlib.contextmanager
def _write_settings(spark: SparkSession) -> Iterator[None]:
    """Small batches and shuffles that go with their write, while any write runs: the first sets them, the last restores."""
    global _writers
    with _lock:
        if not _writers:
            _before.update({k: spark.conf.get(k) for k in (BATCH, CLEANUP)})
            rows = int(_before[BATCH])
            spark.conf.set(BATCH, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))
            spark.conf.set(CLEANUP, "true")
        _writers += 1
    try:
        yield
    finally:
        with _lock:
            _writers -= 1
            if not _writers:
                for k, v in _before.items():
                    spark.conf.set(k, v)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors.

    The write plans anew, so the shuffles that go with it are its own; a job that runs later has none of them.
    A step stays until `discard`, the end of its `scratch` or of the driver.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _steps[path] = spark
    for scope in _scopes:
        scope.append(path)
    with _write_settings(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.step_path = path
    return out


def _delete(path: str) -> None:
    spark = _steps.pop(path, None)
    if spark is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*steps: DataFrame) -> None:
    """Delete written steps that nothing reads any more."""
    for df in steps:
        _delete(df.step_path)


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A scope whose steps go as it ends, but for those handed to the function that it gives."""
    made: list[str] = []
    kept: set[str] = set()
    _scopes.append(made)

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.step_path)
        return df

    try:
        yield keep
    finally:
        _scopes.remove(made)
        for path in made:
            if path not in kept:
                _delete(path)


@atexit.register
def _sweep() -> None:
    for path in list(_steps):
        with contextlib.suppress(Exception):  # the session may be gone by then
            _delete(path)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker, which lives on for later stages, gives its free memory back."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only in the GNU C library
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def sorted_groups(df: DataFrame, keys: list[str], run: Callable[[pa.Table], pa.Table | None], schema: str, least: int = 2000) -> DataFrame:
    """run over the rows of each group of equal keys (not null), read as a stream of sorted neighbours.

    A group has to fit a task; small groups cost no more than a slice. Results go out in batches of `least` rows.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        out: list[pa.Table] = []

        def flush() -> Iterator[pa.RecordBatch]:
            yield from pa.concat_tables(out).combine_chunks().to_batches()
            out.clear()

        def pieces() -> Iterator[pa.Table]:
            nonlocal held
            for batch in batches:
                t = pa.Table.from_batches([batch])
                t = (pa.concat_tables([held, t]) if held is not None else t).combine_chunks()
                if not t.num_rows:
                    continue
                new = np.zeros(t.num_rows - 1, bool)
                for k in keys:
                    column = t[k].chunk(0)
                    new |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero(new) + 1).tolist()]
                for a, b in zip(cuts, cuts[1:]):
                    yield t.slice(a, b - a)
                held = t.slice(cuts[-1])
            if held is not None:
                yield held

        for piece in pieces():
            found = run(piece)
            if found is not None and found.num_rows:
                out.append(found)
                if sum(x.num_rows for x in out) >= least:
                    yield from flush()
        if out:
            yield from flush()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(stream), schema)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt over all cores if it is a small table in fewer files than cores; larger ones stay as they lie."""
    files, cores = len(df.inputFiles()), df.sparkSession.sparkContext.defaultParallelism
    if 0 < files < cores and int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SMALL:
        return df.repartition(cores)
    return df


def with_row_key(df: DataFrame, name: str) -> DataFrame:
    """df with a distinct long per row in `name`, written down: every later read sees the same key at the same row."""
    return materialize(spread(df).withColumn(name, F.monotonically_increasing_id()), "rows")


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores behind it, so that no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def gapless_rank(df: DataFrame, keys: list[str], order: list[str], rows: int, name: str) -> DataFrame:
    """Add `name`: 0, 1, ... within each key, in an order by hash buckets.

    df has to be materialised: it is read twice. A key's rows are spread over buckets, whose number grows with the
    `rows` of df, so a hot key doesn't meet in one task; `order` has to be a total order up to equal rows.
    """
    buckets = max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))
    part = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = part.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_b").alias("_b2"),
        (F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_n")).alias("_at"),
    )
    inside = part.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)) - 1)
    on = F.col("_b") == F.col("_b2")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = inside.join(starts, on, "inner").withColumn(name, (F.col("_at") + F.col("_r")).cast("long"))
    return joined.drop("_b", "_b2", "_at", "_r", *[f"_k{i}" for i in range(len(keys))])


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Connected components: (id, component_id) of every vertex in an edge; component_id is the smallest id.

    Large-star and small-star by turns until the star forest stands still; each round is written to the
    shared folder. Hot centres are joined by broadcast. Nothing but counts comes to the driver.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    now, before = materialize(now, "edges"), None
    rows = now.count()
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("size")).select("u", F.least("m", "u").alias("m"), "size")
        large = join_hot(both, low, ["u"], "size", 2 * rows).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u != v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("size"))
        small = join_hot(large, least, ["u"], "size", 2 * rows).select(F.col("v").alias("u"), F.col("m").alias("v"), F.col("u").alias("w"))
        small = small.where("u != v").select("u", "v").union(small.select(F.col("w").alias("u"), "v")).distinct()
        last, now = now, materialize(small, "stars")
        discard(last, large)
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        rows = mark[0]
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(
        roots.select("id", F.col("id").alias("component_id"))
    )


def least_ids(ends: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, least_id): of each vertex in ends (id, component_id) the smallest `least` over its component's sets (rep, least)."""
    named = materialize(ends.join(sets.select(F.col("rep").alias("id"), "least"), "id"), "ends")
    lowest = named.groupBy("component_id").agg(F.min("least").alias("least_id"), F.count(F.lit(1)).alias("size"))
    return join_hot(named.select("id", "component_id"), lowest, ["component_id"], "size", named.count()).select("id", "least_id")
