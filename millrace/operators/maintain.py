"""Rewrites of a log that keep its reads: compaction, ingestion, excision; and their checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.deal import ranked
from millrace.operators.spans import covering, fragments, overlaps, topped
from millrace.operators.view import CHUNK, DELETIONS


def stripe(seq: Column, snapshots: list[int]) -> Column:
    """Index of the snapshot stripe of a sequence number: how many snapshots don't see it."""
    out = F.lit(0)
    for s in snapshots:
        out = out + (seq >= s).cast("int")
    return out


def single_deletes(log: DataFrame) -> DataFrame:
    """Entries (with stripe) after SINGLEDELs have met what is next below them in their stripe.

    From the newest down: SINGLEDELs in a row count as the newest of them; one that meets a SET or MERGE goes with it,
    and what follows starts anew; one that meets a DEL, DELSIZED or SETWITHDEL becomes a DEL that hides the rest; one
    that meets nothing stays. Keys with a SINGLEDEL only are sorted; their history in a stripe has to fit a task.
    """
    has = log.where("kind = 'SINGLEDEL'").select("key", "stripe").distinct()
    order = Window.partitionBy("key", "stripe").orderBy(F.col("seq").desc())
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = log.join(has, ["key", "stripe"], "left_semi").withColumn("_before", F.lag("kind").over(order))
    single, after = F.col("kind") == "SINGLEDEL", F.coalesce(F.col("_before") == "SINGLEDEL", F.lit(False))
    stops = ~single & ~(after & F.col("kind").isin("SET", "MERGE"))
    rows = rows.withColumn("_stops", stops).withColumn("_stopped", F.max(F.col("_stops").cast("int")).over(so_far))
    # the newest of a row of SINGLEDELs, carried down the row
    begins = single & ~after
    rows = rows.withColumn("_run", F.last(F.when(begins, F.col("seq")), True).over(so_far))
    first = (F.col("_stops") & (F.sum(F.col("_stops").cast("int")).over(so_far) == 1)).alias("_first")
    rows = rows.select("*", first, F.lead("seq").over(order).isNull().alias("_last"))
    turned = F.col("_first") & after & F.col("kind").isin("DEL", "DELSIZED", "SETWITHDEL")
    hides = F.max(turned.cast("int")).over(so_far)
    rows = rows.withColumn("_turned", turned).withColumn("_hides", hides)
    left = rows.where("(_stopped = 1 and _hides = 0) or _turned or (_stopped = 0 and _last and kind = 'SINGLEDEL')")
    moved = F.col("_turned") | (F.col("_stopped") == 0)
    left = left.select(
        "key",
        "stripe",
        F.when(moved, F.col("_run")).otherwise(F.col("seq")).alias("seq"),
        F.when(F.col("_turned"), "DEL").otherwise(F.col("kind")).alias("kind"),
        F.when(~moved, F.col("val")).alias("val"),
        *[c for c in log.columns if c not in ("key", "stripe", "seq", "kind", "val")],
    )
    return log.join(has, ["key", "stripe"], "left_anti").unionByName(left)


def compact(log: DataFrame, snapshots: list[int], bottom: bool = False, deletions: DataFrame | None = None, size: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """key, stripe, seq, kind, val: the log with one entry per key and stripe, as a compaction leaves it.

    Points under a newer range deletion of their own stripe go. Then the newest entry decides: a SET stays, as
    SETWITHDEL if a deletion lies below it; MERGEs fold down to the next other entry, with a SET's value to a SET, onto
    a deletion to a SETWITHDEL, onto nothing to a MERGE; a deletion hides the rest. A DELSIZED (val: the size of the
    entry that it expects to delete) that meets an entry of just that size keeps on with no size, of another size
    becomes a DEL; `size` names the column with an entry's own size. SINGLEDELs go by `single_deletes`, LOGDATA goes.
    At the bottom, where nothing lies beneath, deletions of the oldest stripe go and its merges and SETWITHDELs are
    SETs. Reads at a listed snapshot, or at the newest number, don't change.
    """
    log = log.where(F.col("kind") != "LOGDATA").withColumn("stripe", stripe(F.col("seq"), snapshots))
    if deletions is not None:
        own = [topped(log.where(F.col("stripe") == k), deletions.where(stripe(F.col("seq"), snapshots) == k), "seq", "_over") for k in range(len(snapshots) + 1)]
        log = reduce(DataFrame.unionByName, own).where("_over is null or _over <= seq").drop("_over")
    own = [F.col(size).alias("_size")] if size else [F.lit(None).cast("long").alias("_size")]
    log = single_deletes(log.select("key", "stripe", "seq", "kind", "val", *own))
    # chunks of a stripe fold on their own, then a row per chunk is folded again
    parts = log.withColumn("_chunk", F.floor(F.col("seq") / chunk))
    per = Window.partitionBy("key", "stripe", "_chunk")
    bar = F.max(F.when(F.col("kind") != "MERGE", F.col("seq"))).over(per)
    parts = parts.withColumn("_bar", bar)
    value, gone = F.col("kind").isin("SET", "SETWITHDEL", "MERGE"), F.col("kind").isin(*DELETIONS)
    parts = parts.groupBy("key", "stripe", "_chunk").agg(
        F.max("_bar").alias("_bar"),
        F.max_by("kind", F.when(F.col("kind") != "MERGE", F.col("seq"))).alias("_barred"),
        F.sum(F.when(value & (F.col("seq") >= F.coalesce("_bar", F.lit(-1))), F.col("val"))).alias("_sum"),
        F.max(F.struct("seq", "kind", "val", "_size")).alias("_top"),
        F.max(F.when(gone, F.col("seq"))).alias("_gone"),
        F.max(F.when(F.col("kind") == "SETWITHDEL", F.col("seq"))).alias("_with"),
    )
    last = F.max(F.when(F.col("_bar").isNotNull(), F.col("_chunk"))).over(Window.partitionBy("key", "stripe"))
    parts = parts.withColumn("_fold", F.col("_chunk") >= F.coalesce(last, F.col("_chunk")))
    folded = parts.groupBy("key", "stripe").agg(
        F.max("_top").alias("top"),
        F.max_by("_barred", "_bar").alias("barred"),
        F.sum(F.when(F.col("_fold"), F.col("_sum"))).alias("sum"),
        F.max("_gone").alias("gone"),
    )
    top, barred = F.col("top.kind"), F.col("barred")
    kind = (
        F.when(top == "MERGE", F.when(barred.isNull(), "MERGE").when(barred.isin("SET", "SETWITHDEL"), "SET").otherwise("SETWITHDEL"))
        .when(top == "SET", F.when(F.col("gone").isNotNull(), "SETWITHDEL").otherwise("SET"))
        .otherwise(top)
    )
    val = F.when(top == "MERGE", F.col("sum")).when(top.isin("SET", "SETWITHDEL", "DELSIZED"), F.col("top.val"))
    out = folded.select("key", "stripe", F.col("top.seq").alias("seq"), kind.alias("kind"), val.alias("val"))
    if log.columns and size:
        out = _sized(out, log)
    if bottom:
        old = F.col("stripe") == 0
        out = out.where(~(old & F.col("kind").isin(*DELETIONS)))
        out = out.withColumn("kind", F.when(old & F.col("kind").isin("MERGE", "SETWITHDEL"), "SET").otherwise(F.col("kind")))
    return out


def _sized(out: DataFrame, log: DataFrame) -> DataFrame:
    """DELSIZED entries of out against what lies below them in their stripe, newest first.

    A DELSIZED below hands on its own size; a DEL or SINGLEDEL below makes it a DEL. An entry of just the expected
    size uses the size up (null from then on); one of another size, or one that is met with the size used up, makes it a DEL.
    """
    sized = out.where("kind = 'DELSIZED'").select("key", "stripe")
    own = log.join(sized, ["key", "stripe"], "left_semi").groupBy("key", "stripe").agg(F.array_sort(F.collect_list(F.struct((-F.col("seq")).alias("o"), "kind", "val", "_size"))).alias("all"))
    state = F.struct(F.lit("DELSIZED").alias("kind"), F.lit(None).cast("long").alias("val"))

    def meet(acc: Column, e: Column) -> Column:
        kind, hint = acc["kind"], acc["val"]
        to = lambda k, v: F.struct(k.alias("kind"), v.alias("val"))
        none = F.lit(None).cast("long")
        return (
            F.when(kind == "DEL", acc)
            .when(e["kind"] == "DELSIZED", to(F.lit("DELSIZED"), e["val"]))
            .when(e["kind"].isin("DEL", "SINGLEDEL"), to(F.lit("DEL"), none))
            .when(hint == e["_size"], to(F.lit("DELSIZED"), none))
            .otherwise(to(F.lit("DEL"), none))
        )

    met = own.select("key", "stripe", F.aggregate("all", state, meet).alias("_met"))
    return out.join(met, ["key", "stripe"], "left").select(
        "key", "stripe", "seq", F.coalesce("_met.kind", "kind").alias("kind"), F.when(F.col("_met").isNotNull(), F.col("_met.val")).otherwise(F.col("val")).alias("val")
    )


def compact_deletions(deletions: DataFrame, snapshots: list[int], bottom: bool = False) -> DataFrame:
    """Range deletions fragmented, the newest of each fragment and stripe; at the bottom those of the oldest stripe go."""
    out = fragments(deletions.select("start", "stop", "seq")).withColumn("stripe", stripe(F.col("seq"), snapshots))
    out = out.groupBy("start", "stop", "stripe").agg(F.max("seq").alias("seq"))
    return out.where("stripe != 0") if bottom else out


def elide_tombstones(log: DataFrame, in_use: DataFrame) -> DataFrame:
    """Without deletions that no file of a lower level can hold the key of; in_use: (lo, hi), both in the range."""
    gone = F.col("kind").isin(*DELETIONS)
    inner = topped(log.where(gone), in_use.select(F.col("lo").alias("start"), F.col("hi").alias("stop"), F.lit(1).alias("_one")), "_one", "_in")
    ends = in_use.select(F.col("hi").alias("key"), F.lit(1).alias("_end")).distinct()
    kept = inner.join(ends, "key", "left").where("_in = 1 or _end = 1").drop("_in", "_end")
    return log.where(~gone).unionByName(kept)


def ingest(log: DataFrame, rows: DataFrame, file_col: str, base: int | Column) -> DataFrame:
    """Files become visible together, each under its own consecutive number from base on, in the order of its smallest key."""
    order = rows.groupBy(file_col).agg(F.min("key").alias("_lo"))
    order = ranked(order.select(file_col, F.struct("_lo", file_col).alias("_by")), "_by", "_n")
    new = rows.join(order.select(file_col, "_n"), file_col).withColumn("kind", F.lit("SET"))
    base = F.lit(base) if isinstance(base, int) else base
    return log.select("key", "seq", "kind", "val").unionByName(new.select("key", (F.col("_n") + base).cast("long").alias("seq"), "kind", "val"))


def ingest_overlaps(files: DataFrame) -> DataFrame:
    """Files that overlap the one before in key order; a correct ingestion has none."""
    order = ranked(files.withColumn("_by", F.struct("smallest", "file_id")), "_by", "_n").drop("_by")
    before = order.select((F.col("_n") + 1).alias("_n"), F.col("largest").alias("before"))
    return order.join(before, "_n").where("before >= smallest").drop("_n")


def excise(log: DataFrame, lower: object, upper: object) -> DataFrame:
    """The log without [lower, upper), for snapshots too."""
    return log.where((F.col("key") < F.lit(lower)) | (F.col("key") >= F.lit(upper)))


def beneath(files: DataFrame, deletions: DataFrame) -> DataFrame:
    """Older files (smallest, largest, max_seq) that overlap each range deletion, a row per pair."""
    hit = overlaps(files.withColumnsRenamed({"smallest": "lo", "largest": "hi"}), deletions)
    return hit.where("max_seq < seq").withColumnsRenamed({"lo": "smallest", "hi": "largest"})


def wholly_deleted(files: DataFrame, deletions: DataFrame) -> DataFrame:
    """Files that a newer range deletion holds whole."""
    hit = covering(files.withColumn("key", F.col("smallest")), deletions).where("largest < stop and max_seq < seq")
    return hit.select(files.columns).distinct()


def target_level(new: DataFrame, files: DataFrame, bottom: int) -> DataFrame:
    """(id, target) for files to ingest (id, lo, hi): the level above the first that overlaps, or the bottom."""
    old = files.select(F.col("smallest").alias("lo"), F.col("largest").alias("hi"), "level")
    spans = new.select("id", F.col("lo").alias("start"), F.col("hi").alias("stop"))
    # [lo, hi) meets an inner key or an end; the file to ingest also holds its last key
    at_end = topped(new.select("id", F.col("hi").alias("key")), old.select(F.col("lo").alias("start"), F.col("hi").alias("stop"), (-F.col("level")).alias("_up")), "_up", "_level").select("id", (-F.col("_level")).alias("level"))
    touch = new.select("id", F.col("hi").alias("at")).join(old.select(F.explode(F.array("lo", "hi")).alias("at"), "level"), "at").select("id", "level")
    inside = overlaps(old, spans.where("start < stop")).select("id", "level")
    first = inside.unionByName(at_end).unionByName(touch).groupBy("id").agg(F.min("level").alias("level"))
    return new.select("id").join(first, "id", "left").select("id", F.when(F.col("level").isNull(), F.lit(bottom)).otherwise(F.greatest(F.col("level") - 1, F.lit(0))).alias("target"))


def compact_range_keys(frags: DataFrame, snapshots: list[int], bottom: bool = True) -> DataFrame:
    """Fragments of range keys coalesced per stripe: the newest DEL, and what isn't older, the newest per suffix.

    At the bottom nothing lies beneath the oldest stripe, so its UNSETs and DELs go.
    """
    part = frags.withColumn("stripe", stripe(F.col("seq"), snapshots))
    span = Window.partitionBy("start", "stop", "stripe")
    dead = F.coalesce(F.max(F.when(F.col("kind") == "DEL", F.col("seq"))).over(span), F.lit(-1))
    suffix = F.when(F.col("kind") != "DEL", F.col("suffix"))
    rank = F.when(F.col("kind") == "SET", 0).otherwise(1)
    per = Window.partitionBy("start", "stop", "stripe", F.col("kind") == "DEL", "suffix").orderBy(F.col("seq").desc(), rank, F.col("val").desc())
    alive = part.withColumn("_dead", dead).where("seq >= _dead").withColumn("suffix", suffix)
    out = alive.withColumn("_r", F.row_number().over(per)).where("_r = 1").drop("_r", "_dead")
    return out.where("not (stripe = 0 and kind != 'SET')") if bottom else out


def deterministic(log: DataFrame) -> DataFrame:
    """key, seq, same of every key whose newest entry is a value: whether a SINGLEDEL deletes it as surely as a DEL.

    It doesn't if a value could come to light: one below the newest, above any DEL or DELSIZED, that no SINGLEDEL
    right above it takes along. Range deletions are to be applied before.
    """
    log = log.where(F.col("kind") != "LOGDATA")
    top = log.groupBy("key").agg(F.max(F.struct("seq", "kind")).alias("_top"), F.max(F.when(F.col("kind").isin("DEL", "DELSIZED"), F.col("seq"))).alias("_del"))
    top = top.where(F.col("_top.kind").isin("SET", "SETWITHDEL", "MERGE"))
    left = log.join(top, "key").where("seq >= coalesce(_del, -1)")
    above = F.lag("kind").over(Window.partitionBy("key").orderBy(F.col("seq").desc()))
    shown = (F.col("seq") < F.col("_top.seq")) & F.col("kind").isin("SET", "SETWITHDEL", "MERGE") & (F.col("_above") != "SINGLEDEL")
    return left.withColumn("_above", above).groupBy("key").agg(F.max("seq").alias("seq"), (F.max(F.coalesce(shown, F.lit(False)).cast("int")) == 0).alias("same"))
