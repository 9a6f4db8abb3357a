"""How rows are dealt over tasks: joins that don't meet a hot key in one task, and cells of any ordered key space.

Only comparisons of keys are used, so keys may be numbers, strings or binary (in byte order). But for `settle`, nothing
here runs a job while a plan is built: cuts are a scalar subquery of the plan itself.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A key is hot if it holds more than one in HOT of all rows, so there are fewer than HOT such keys.
HOT = 1000
#: Sampled keys per cell, salts of a lookup whose probes may share a key, ranks that one row expands to at a time.
PER_CELL, SALTS, STEP = 16, 8, 1024
#: Marks that are sent to every task; more of them are dealt by key range with their probes.
FEW_MARKS = 4096


def join_hot(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with groups (a row per key, `size` of them rows or more) by "inner" or "left".

    Hot keys are fewer than HOT by their definition, so that part of groups is broadcast and its rows stay where
    they are; what is left has at most total / HOT rows per key and is shuffled. rows is read twice.
    """
    hot = F.col(size) * HOT > total
    few = groups.where(hot)
    near = rows.join(F.broadcast(few), keys)
    far = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(groups.where(~hot), keys, how)
    return near.unionByName(far)


def settle(df: DataFrame) -> DataFrame:
    """df, run and written to the checkpoint folder, so that what reads it several times doesn't repeat its plan.

    Only a local master may go without spark.checkpoint.dir: one machine holds all tasks then.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="millrace-"))
    return df.checkpoint()


def looked_up(marks: DataFrame, probes: DataFrame, key: str, carried: list[str]) -> DataFrame:
    """As `nearest` going back, for settled marks of at most FEW_MARKS rows: a sorted array that every task searches by
    halving, so probes aren't moved at all."""
    found = marks.agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("_key"), F.struct(*carried).alias("_mark")))).alias("all")).scalar()
    lo, hi = F.lit(0).alias("lo"), F.size("_marks").alias("hi")

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        up = F.get("_marks", mid)["_key"] <= F.col(key)
        moved = F.struct(F.when(up, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(mid).alias("hi"))
        return F.when(s["lo"] >= s["hi"], s).otherwise(moved)

    at = F.aggregate(F.sequence(F.lit(1), F.lit(FEW_MARKS.bit_length() + 1)), F.struct(lo, hi), halve)["lo"] - 1
    got = F.when(at >= 0, F.get("_marks", F.greatest(at, F.lit(0)))["_mark"])
    out = probes.withColumn("_marks", found).withColumn("_got", got).drop("_marks")
    return out.select(*probes.columns, *[F.col(f"_got.{c}").alias(c) for c in carried])


def cuts(df: DataFrame, key: str) -> Column:
    """A sorted array of keys that cut df into like parts, one part per shuffle partition of the session.

    They are quantiles of a bounded sample: the distinct keys of the smallest hashes, so a repeated run cuts alike.
    """
    cells = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = df.select(F.col(key).alias("k")).where("k is not null").distinct().orderBy(F.xxhash64("k"), "k").limit(PER_CELL * cells)
    at = F.transform(F.sequence(F.lit(1), F.lit(max(1, cells - 1))), lambda i: F.get("all", F.floor(i * F.size("all") / cells).cast("int")))
    return found.agg(F.array_sort(F.collect_list("k")).alias("all")).select(F.array_distinct(F.filter(at, lambda x: x.isNotNull()))).scalar()


def with_cell(df: DataFrame, key: str, by: Column) -> DataFrame:
    """df with `_cell`: how many cuts are at or below the key, by halving; `_cell` is below the shuffle partitions."""
    halvings = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")).bit_length() + 1
    lo, hi = F.lit(0).alias("lo"), F.size("_cuts").alias("hi")

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        up, done = F.get("_cuts", mid) <= F.col(key), s["lo"] >= s["hi"]
        return F.when(done, s).otherwise(F.struct(F.when(up, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(mid).alias("hi")))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), F.struct(lo, hi), halve)["lo"]
    return df.withColumn("_cuts", by).withColumn("_cell", found).drop("_cuts")


def _ahead(parts: DataFrame, value: str) -> DataFrame:
    """Per cell the sum of value over the cells before: a window over a row per cell."""
    return parts.select("_cell", (F.sum(value).over(Window.orderBy("_cell")) - F.col(value)).alias("_at"))


def ranked(df: DataFrame, key: str, name: str = "_rank", following: str | None = None) -> DataFrame:
    """df, whose keys are distinct, with `name`: 0, 1, ... in key order, and with `following`: the next key.

    Cells rank on their own and move by the counts of those before; counts and first keys are a row per cell, which
    is broadcast.
    """
    dealt = with_cell(df, key, cuts(df, key))
    past, later = Window.orderBy("_cell"), Window.orderBy(F.col("_cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("_k"))
    starts = starts.select("_cell", (F.sum("_n").over(past) - F.col("_n")).alias("_at"), F.last("_k").over(later).alias("_k"))  # a row per cell
    w = Window.partitionBy("_cell").orderBy(key)
    own = dealt.withColumn("_r", F.row_number().over(w) - 1)
    if following:
        own = own.withColumn("_f", F.lead(key).over(w))
    out = own.join(F.broadcast(starts), "_cell").withColumn(name, (F.col("_at") + F.col("_r")).cast("long"))
    if following:
        out = out.withColumn(following, F.coalesce("_f", "_k")).drop("_f")
    return out.drop("_cell", "_at", "_r", "_k")


def prefix_sums(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """df, whose keys are distinct, with `name`: the sum of value over all keys up to its own."""
    dealt = with_cell(df, key, cuts(df, key))
    starts = _ahead(dealt.groupBy("_cell").agg(F.sum(value).alias("_n")), "_n")
    own = dealt.withColumn("_r", F.sum(value).over(Window.partitionBy("_cell").orderBy(key)))
    return own.join(F.broadcast(starts), "_cell").withColumn(name, F.col("_at") + F.col("_r")).drop("_cell", "_at", "_r")


def nearest(marks: DataFrame, probes: DataFrame, key: str, carried: list[str], before: bool = True, salts: int = 1, strict: bool = False) -> DataFrame:
    """probes, with the columns `carried` of the last of marks (distinct keys) at or before their key, or of the first
    at or after it; null for none. strict leaves out a mark at the probe's own key.

    One sorted pass per cell; what a cell lacks comes from the nearest mark of the cells beside it, a row per cell.
    Where probes may share a key, salts spread them, each with a copy of the marks.
    """
    by = cuts(marks.select(key).union(probes.select(key)), key)
    own = [c for c in probes.columns if c != key]
    m = with_cell(marks.select(key, F.struct(*carried).alias("_mark")), key, by)
    p = with_cell(probes.select(key, F.struct(F.lit(1).alias("_one"), *own).alias("_own")), key, by)
    p = p.withColumn("_salt", F.pmod(F.xxhash64(key, "_own"), F.lit(salts)).cast("int") if salts > 1 else F.lit(0))
    copies = m.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    both = copies.withColumn("_is", F.lit(0)).unionByName(p.withColumn("_is", F.lit(1)), allowMissingColumns=True)
    order = [F.col(key) if before else F.col(key).desc(), F.col("_is").desc() if strict else F.col("_is")]
    w = Window.partitionBy("_cell", "_salt").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_near", F.last("_mark", True).over(w)).where("_is = 1")
    edge = m.groupBy("_cell").agg((F.max_by if before else F.min_by)("_mark", key).alias("_edge"))
    cells = marks.sparkSession.range(int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    every = cells.select(F.col("id").cast("int").alias("_cell")).join(edge, "_cell", "left")  # a row per cell
    past = Window.orderBy(F.col("_cell") if before else F.col("_cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    far = every.select("_cell", F.last("_edge", True).over(past).alias("_far"))
    found = found.join(F.broadcast(far), "_cell", "left").withColumn("_got", F.coalesce("_near", "_far"))
    return found.select(key, *[F.col(f"_own.{c}").alias(c) for c in own], *[F.col(f"_got.{c}").alias(c) for c in carried])


def expand(df: DataFrame, first: str, last: str, name: str) -> DataFrame:
    """A row per number from first to last, in steps, so that no array is long."""
    steps = F.sequence(F.floor(F.col(first) / STEP), F.floor(F.col(last) / STEP))
    part = df.where(F.col(first) <= F.col(last)).withColumn("_step", F.explode(steps))
    inside = F.sequence(F.greatest(F.col(first), F.col("_step") * STEP), F.least(F.col(last), F.col("_step") * STEP + STEP - 1))
    return part.withColumn(name, F.explode(inside)).drop("_step")
