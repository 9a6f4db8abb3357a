"""Interval operators: fragmenting, coalescing, defragmenting, clipping. Keys may be numbers, strings or binary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.deal import FEW_MARKS, SALTS, expand, looked_up, nearest, ranked, settle


def fragments(spans: DataFrame) -> DataFrame:
    """Spans cut at every boundary inside them: fragments are equal or disjoint. Repeated spans stay repeated.

    Boundaries are numbered in key order; a span is the numbers between those of its ends. No interval join, and a
    span costs what it is cut into, however many keys it covers.
    """
    spans = spans.where("start < stop")
    edges = ranked(spans.select(F.explode(F.array("start", "stop")).alias("at")).distinct(), "at", "n", "next")
    begin, end = (edges.select(F.col("at").alias(c), F.col("n").alias(f"_{c}")) for c in ("start", "stop"))
    inside = [c for c in spans.columns if c not in ("start", "stop")]
    cut = spans.join(begin, "start").join(end, "stop").withColumn("_last", F.col("_stop") - 1)
    cut = expand(cut.select(*inside, "_start", "_last"), "_start", "_last", "n")
    return cut.join(edges, "n").select(F.col("at").alias("start"), F.col("next").alias("stop"), *inside)


def profile(spans: DataFrame, top: str) -> DataFrame:
    """Disjoint (start, stop, top): the largest value of a column over each part of the key space that spans cover."""
    return fragments(spans.select("start", "stop", top)).groupBy("start", "stop").agg(F.max(top).alias(top))


def _last_mark(marks: DataFrame, points: DataFrame, carried: list[str]) -> DataFrame:
    """Points with the last mark at or before them. Marks are settled first; few are sent to every task (their number is
    checked), more are dealt by key range."""
    marks = settle(marks)
    few = marks.limit(FEW_MARKS + 1).count() <= FEW_MARKS
    return looked_up(marks, points, "key", carried) if few else nearest(marks, points, "key", carried, True, SALTS)


def topped(points: DataFrame, spans: DataFrame, top: str, name: str) -> DataFrame:
    """points (key) with `name`: the largest value of a column among spans [start, stop) over the key; null for none."""
    marks = profile(spans, top).select(F.col("start").alias("key"), F.col("stop").alias("_stop"), F.col(top).alias("_top"))
    found = _last_mark(marks, points, ["_stop", "_top"])
    return found.withColumn(name, F.when(F.col("key") < F.col("_stop"), F.col("_top"))).drop("_stop", "_top")


def covering(points: DataFrame, spans: DataFrame, disjoint: bool = False) -> DataFrame:
    """A row per point (key) and span over it: the columns of both, of distinct names. Disjoint spans aren't cut first."""
    own = [c for c in spans.columns if c not in ("start", "stop")]
    if disjoint:
        return _last_mark(spans.withColumn("key", F.col("start")), points, ["start", "stop", *own]).where(F.col("key") < F.col("stop"))
    whole = spans.where("start < stop").select("start", "stop", F.struct("start", "stop", *own).alias("_span"))
    parts = fragments(whole).groupBy("start", "stop").agg(F.collect_list("_span").alias("_spans"))
    marks = parts.select(F.col("start").alias("key"), F.col("stop").alias("_to"), "_spans")
    found = _last_mark(marks, points, ["_to", "_spans"]).where(F.col("key") < F.col("_to"))
    return found.select(*points.columns, F.explode("_spans").alias("_span")).select(*points.columns, "_span.*")


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """A row per pair of spans of a (lo, hi, both in it) and b (start, stop) that share a key: either begins in the other."""
    first = covering(a.withColumn("key", F.col("lo")), b).drop("key")
    # the least key above hi isn't known for every type, so hi is compared after the lookup of spans [lo, hi)
    held = b.where("start < stop").withColumn("key", F.col("start"))
    ends = covering(held.withColumnsRenamed({"start": "_bs", "stop": "_be"}), a.withColumnsRenamed({"lo": "start"}).withColumn("stop", F.col("hi")).withColumn("_lo", F.col("start")))
    second = ends.where(F.col("_bs") > F.col("_lo")).drop("key", "start", "stop").withColumnsRenamed({"_bs": "start", "_be": "stop", "_lo": "lo"})
    last = held.join(a.withColumn("key", F.col("hi")), "key").where(F.col("start") > F.col("lo")).drop("key")
    return first.unionByName(second.select(first.columns)).unionByName(last.select(first.columns))


def coalesce(frags: DataFrame) -> DataFrame:
    """Range keys that a reader sees, per fragment: newer than its newest DEL, the newest per suffix, SETs only.

    At one sequence number a SET comes before an UNSET and both before a DEL, so a DEL spares its equals.
    """
    span = Window.partitionBy("start", "stop")
    dead = F.coalesce(F.max(F.when(F.col("kind") == "DEL", F.col("seq"))).over(span), F.lit(-1))
    rank = F.when(F.col("kind") == "SET", 0).otherwise(1)
    per = Window.partitionBy("start", "stop", "suffix").orderBy(F.col("seq").desc(), rank, F.col("val").desc())
    alive = frags.withColumn("_dead", dead).where("kind != 'DEL' and seq >= _dead")
    return alive.withColumn("_r", F.row_number().over(per)).where("_r = 1 and kind = 'SET'").drop("_dead", "_r")


def defragment(frags: DataFrame) -> DataFrame:
    """Fragments of one state (the list of suffixes and values) that abut become one."""
    state = F.transform(F.array_sort(F.collect_list(F.struct("suffix", "val"))), lambda x: F.concat_ws("=", x["suffix"], x["val"]))
    return join_abutting(frags.groupBy("start", "stop").agg(F.array_join(state, ",").alias("state")), ["state"])


def join_abutting(frags: DataFrame, same: list[str]) -> DataFrame:
    """Fragments that abut and are equal in the given columns become one.

    A fragment that none of its kind ends at begins a run; the others take the last beginning before them.
    """
    w = Window.partitionBy(*same).orderBy("start")
    new = F.coalesce((F.lag("stop").over(w) != F.col("start")).cast("int"), F.lit(1))
    runs = frags.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy(*same, "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_run")


def truncate(spans: DataFrame, lower: object, upper: object) -> DataFrame:
    """Spans clipped to [lower, upper); empty ones go."""
    clipped = spans.withColumn("start", F.greatest("start", F.lit(lower))).withColumn("stop", F.least("stop", F.lit(upper)))
    return clipped.where("start < stop")


def overlapping(spans: DataFrame, lower: object, upper: object) -> DataFrame:
    return spans.where((F.col("start") < F.lit(upper)) & (F.col("stop") > F.lit(lower)))


def excise(spans: DataFrame, lower: object, upper: object) -> DataFrame:
    """Spans without [lower, upper); one may split in two."""
    left = spans.withColumn("stop", F.least("stop", F.lit(lower)))
    right = spans.withColumn("start", F.greatest("start", F.lit(upper)))
    return left.unionByName(right).where("start < stop")


def keep(spans: DataFrame, condition: Column) -> DataFrame:
    """Spans whose operation passes a predicate: a filter on each, which leaves the others of its fragment alone."""
    return spans.where(condition)


def transform(spans: DataFrame, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Spans through a function of their columns; bounds that end up empty go."""
    return change(spans).where("start < stop")


def foreign(spans: DataFrame, seq: int) -> DataFrame:
    """Range keys of a file that another store wrote, as the reader sees them: all at one sequence number, coalesced."""
    return coalesce(fragments(spans)).withColumn("seq", F.lit(seq).cast("long"))
