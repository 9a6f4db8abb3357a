"""The resolved view of an operation log, and reads over it. Keys may be numbers, strings or binary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.deal import nearest
from millrace.operators.spans import topped

#: Kinds that give a value and kinds that delete; SETWITHDEL reads like SET, the three deletions alike, LOGDATA not at all.
VALUES, DELETIONS = ("SET", "SETWITHDEL", "MERGE"), ("DEL", "SINGLEDEL", "DELSIZED")
#: Sequence numbers of a chunk: a hot key's entries meet in chunks, not in one task.
CHUNK = 1 << 20


def visible(log: DataFrame, snapshot: int | None) -> DataFrame:
    """What a reader at the snapshot sees: strictly older entries."""
    return log if snapshot is None else log.where(F.col("seq") < snapshot)


def delete_ranges(log: DataFrame, deletions: DataFrame) -> DataFrame:
    """Points that no newer range deletion covers; an equal sequence number doesn't delete."""
    return topped(log, deletions, "seq", "_over").where("_over is null or _over <= seq").drop("_over")


def live_chunks(log: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per key and chunk of sequence numbers the entries that count: from the key's newest SET or deletion on.

    Chunks find their own newest barrier first; those before a key's last barrier go, a row per key and chunk.
    """
    log = log.where(F.col("kind") != "LOGDATA").withColumn("_chunk", F.floor(F.col("seq") / chunk))
    bar = F.max(F.when(F.col("kind") != "MERGE", F.col("seq"))).over(Window.partitionBy("key", "_chunk"))
    return log.withColumn("_bar", bar).where("seq >= coalesce(_bar, -1)")


def resolve(log: DataFrame, deletions: DataFrame | None = None, snapshot: int | None = None, trail: bool = False, chunk: int = CHUNK) -> DataFrame:
    """key, val (operands summed), n, newest seq of every key that exists; with `trail` also its operands old to new,
    which then have to fit a row."""
    seen = visible(log, snapshot)
    if deletions is not None:
        seen = delete_ranges(seen, visible(deletions, snapshot))
    kept, value = live_chunks(seen, chunk), F.col("kind").isin(*VALUES)
    some = [F.collect_list(F.when(value, F.struct("seq", "val"))).alias("trail")] if trail else []
    parts = kept.groupBy("key", "_chunk").agg(
        F.max("_bar").alias("_bar"), F.sum(F.when(value, F.col("val"))).alias("val"), F.count_if(value).alias("n"), F.max(F.when(value, F.col("seq"))).alias("seq"), *some
    )
    last = F.max(F.when(F.col("_bar").isNotNull(), F.col("_chunk"))).over(Window.partitionBy("key"))
    parts = parts.withColumn("_last", last).where("_chunk >= coalesce(_last, _chunk)")
    some = [F.array_join(F.transform(F.array_sort(F.flatten(F.collect_list("trail"))), lambda x: x["val"].cast("string")), ",").alias("trail")] if trail else []
    return parts.groupBy("key").agg(F.sum("val").alias("val"), F.sum("n").alias("n"), F.max("seq").alias("seq"), *some).where("n > 0")


def overwritten(log: DataFrame) -> DataFrame:
    """key, val, seq under the merger that overwrites: the newest operand counts, if no deletion is newer."""
    newest = log.where(F.col("kind") != "LOGDATA").groupBy("key").agg(F.max_by(F.struct("kind", "val", "seq"), "seq").alias("e"))
    return newest.where(F.col("e.kind").isin(*VALUES)).select("key", "e.val", "e.seq")


def newest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The row of each group that is largest in a total order, by partial aggregation: a group may be of any size."""
    rest = [c for c in df.columns if c not in by]
    top = F.max_by(F.struct(*rest), F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)]))
    return df.groupBy(*by).agg(top.alias("_top")).select(*by, "_top.*")


def overlay(log: DataFrame, batch: DataFrame) -> DataFrame:
    """A batch over a log: its entries are newer than any other (fixed value: bit 55 marks them)."""
    return log.unionByName(batch.withColumn("seq", F.col("seq") + 2**55))


def seek(view: DataFrame, probes: DataFrame, forward: bool, limit: str | None = None) -> DataFrame:
    """Per probe the first key at or after it, or the last before it, null for none; probes keep their other columns.

    With `limit`, a column of probes, a key at or past the limit (before it, going back) counts as none: the position
    is then `at_limit` and not exhausted.
    """
    marks = view.select("key", F.col("key").alias("found")).distinct()
    got = nearest(marks, probes.withColumnRenamed("probe", "key"), "key", ["found"], not forward, strict=not forward).withColumnRenamed("key", "probe")
    if limit is None:
        return got
    past = F.col("found").isNotNull() & (F.col("found") >= F.col(limit) if forward else F.col("found") < F.col(limit))
    return got.withColumn("at_limit", past).withColumn("found", F.when(~past, F.col("found")))


def steps(view: DataFrame) -> DataFrame:
    """key with the keys before and after it (null at the ends): what one step back and forward give."""
    marks = view.select("key", F.col("key").alias("found")).distinct()
    back = nearest(marks, marks.select("key"), "key", ["found"], True, strict=True).withColumnRenamed("found", "previous")
    return nearest(marks, back, "key", ["found"], False, strict=True).withColumnRenamed("found", "next")


def masked(points: DataFrame, marks: DataFrame, threshold: int) -> DataFrame:
    """Points (key, suffix) without those older than a covering range key that is no newer than the threshold.

    Points without a suffix are never masked, and range keys without one mask nothing.
    """
    low = marks.where((F.col("kind") == "SET") & (F.col("suffix") <= threshold)).withColumnRenamed("suffix", "_low")
    return topped(points, low, "_low", "_over").where("_over is null or suffix is null or suffix >= _over").drop("_over")


def internal_scan(log: DataFrame, deletions: DataFrame, range_keys: DataFrame, snapshot: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a scan below the surface visits at a snapshot: points, range deletions and range keys, each in its own table.

    Points are the newest entry of each key that no range deletion covers, deletions included. A newest entry that is
    a MERGE or SINGLEDEL can't be given alone: it raises an error when it is read. Range deletions come fragmented,
    the newest of each fragment; range keys come fragmented and coalesced, deletions included.
    """
    from millrace.operators.maintain import compact_deletions, compact_range_keys
    from millrace.operators.spans import fragments

    seen = delete_ranges(visible(log, snapshot), visible(deletions, snapshot)).where(F.col("kind") != "LOGDATA")
    top = newest(seen, ["key"], [F.col("seq")])
    plain = F.when(F.col("kind").isin("MERGE", "SINGLEDEL"), F.raise_error(F.concat(F.lit("a scan below the surface met "), F.col("kind")))).otherwise(F.col("kind"))
    points = top.withColumn("kind", plain.cast("string"))
    spans = compact_deletions(visible(deletions, snapshot), [], bottom=False).drop("stripe")
    return points, spans, compact_range_keys(fragments(visible(range_keys, snapshot)), [], bottom=False).drop("stripe")


def combined(points: DataFrame, spans: DataFrame, lower: object = None, upper: object = None, kinds: str = "both") -> DataFrame:
    """Positions of an iterator over points (key, val) and range keys (disjoint start, stop and other columns): key,
    has_point, has_range, val, range_start, range_end, clipped to [lower, upper).

    kinds "points" or "ranges" leaves the others out. A span shows at its (clipped) start and at every point in it.
    """
    from millrace.operators.spans import covering, truncate

    low = points if lower is None else points.where(F.col("key") >= F.lit(lower))
    points = (low if upper is None else low.where(F.col("key") < F.lit(upper))).select("key", "val")
    spans = spans.select("start", "stop").distinct()
    if lower is not None and upper is not None:
        spans = truncate(spans, lower, upper)
    if kinds == "points":
        spans = spans.where(F.lit(False))
    if kinds == "ranges":
        points = points.where(F.lit(False))
    hit = covering(points, spans, True).select("key", F.col("start").alias("range_start"), F.col("stop").alias("range_end"))
    both = points.join(hit, "key", "left").select("key", F.lit(True).alias("has_point"), F.col("range_start").isNotNull().alias("has_range"), "val", "range_start", "range_end")
    alone = spans.join(points, spans["start"] == points["key"], "left_anti").withColumnsRenamed({"start": "range_start", "stop": "range_end"})
    blank = F.lit(None).cast(dict(points.dtypes)["val"])
    return both.unionByName(alone.select(F.col("range_start").alias("key"), F.lit(False).alias("has_point"), F.lit(True).alias("has_range"), blank.alias("val"), "range_start", "range_end"))
