"""Statistics about keys, files, levels and maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.deal import prefix_sums, ranked


def scan_statistics(log: DataFrame) -> DataFrame:
    """Per kind and in all: entries, newest entries of their key, and entries that newer ones shadow.

    The newest of a key is one aggregate per key, so a hot key is folded before it is shuffled.
    """
    newest = log.groupBy("key").agg(F.max_by("kind", "seq").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("newest"))
    per = log.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).join(newest, "kind", "left").na.fill(0, ["newest"])
    return per.rollup("kind").agg(F.sum("n").alias("n"), F.sum("newest").alias("newest"), (F.sum("n") - F.sum("newest")).alias("pinned"))


def disk_usage(files: DataFrame, lower: object, upper: object) -> DataFrame:
    """Per level and in all, of files that meet [lower, upper]: n_files, bytes, whole_bytes of files inside the bounds, and
    by `placement` the local, shared and external bytes; remote is shared and external, total is remote and local."""
    if lower > upper:
        raise ValueError("the range ends before it starts")
    hit = files.where((F.col("smallest") <= F.lit(upper)) & (F.col("largest") >= F.lit(lower)))
    whole = (F.col("smallest") >= F.lit(lower)) & (F.col("largest") <= F.lit(upper))
    of = lambda on, name: F.coalesce(F.sum(F.when(on, F.col("bytes"))), F.lit(0)).alias(name)
    place = F.col("placement") if "placement" in files.columns else F.lit("local")
    return hit.rollup("level").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        of(whole, "whole_bytes"),
        of(place == "local", "local"),
        of(place == "shared", "shared"),
        of(place == "external", "external"),
        of(place != "local", "remote"),
    )


def mid_key(units: DataFrame, lower: object, upper: object, epsilon: int) -> DataFrame:
    """One row at most: the key at which half the bytes in [lower, upper) are reached, and the bytes up to it.

    units (smallest, largest, bytes) are files, or blocks of files for a finer answer, with the bytes that they hold
    in the range. None if all hold no more than 2 * epsilon, if the first unit to come within epsilon of half passes
    it by more, or if its end isn't strictly inside the range.
    """
    if lower >= upper:
        raise ValueError("the range ends before it starts")
    end = F.least("largest", F.lit(upper))
    hit = units.where((F.col("smallest") < F.lit(upper)) & (F.col("largest") >= F.lit(lower)))
    ends = hit.groupBy(end.alias("end")).agg(F.sum("bytes").alias("bytes"))
    run = prefix_sums(ends, "end", "bytes", "run")
    total = run.agg(F.max("run")).scalar()
    half = F.floor(F.col("total") / 2)
    first = run.withColumn("total", total).where((F.col("total") > 2 * epsilon) & (F.col("run") >= half - epsilon))
    first = first.groupBy().agg(F.min_by(F.struct("end", "run", "total"), "run").alias("m")).where("m is not null").select("m.*")
    return first.where((F.col("run") <= half + epsilon) & (F.col("end") > F.lit(lower)) & (F.col("end") < F.lit(upper))).select(F.col("end").alias("mid_key"), "run")


def level_metrics(files: DataFrame) -> DataFrame:
    return files.rollup("level").agg(F.count(F.lit(1)).alias("n_files"), F.sum("bytes").alias("bytes"), F.sum("entries").alias("entries"))


def write_amplification(levels: DataFrame, wal_bytes: Column | int) -> DataFrame:
    """Per level and in all (level null): bytes_in, bytes_out, write_amp; levels has level, bytes_in, bytes_ingested,
    bytes_flushed, bytes_compacted.

    A level's factor is what is flushed and compacted into it over what came in, 0 if nothing did. In all, what comes
    in is the log and the ingested bytes, and the log's bytes count as written once more.
    """
    factor = lambda out, into: F.when(into == 0, F.lit(0.0)).otherwise(out / into)
    each = levels.select("level", "bytes_in", (F.col("bytes_flushed") + F.col("bytes_compacted")).alias("bytes_out"))
    wal = F.lit(wal_bytes) if isinstance(wal_bytes, int) else wal_bytes
    all_ = levels.agg(F.sum("bytes_ingested").alias("i"), F.sum(F.col("bytes_flushed") + F.col("bytes_compacted")).alias("o"))
    all_ = all_.withColumn("w", wal).select(F.lit(None).cast(dict(levels.dtypes)["level"]).alias("level"), (F.col("w") + F.col("i")).alias("bytes_in"), (F.col("o") + F.col("w") + F.col("i")).alias("bytes_out"))
    both = each.unionByName(all_)
    return both.withColumn("write_amp", factor(F.col("bytes_out"), F.col("bytes_in")).cast("double"))


def read_amplification(sublevels: DataFrame) -> DataFrame:
    """One row: how many sorted runs a read may have to look at, the sublevels of the first level and one per other level with files."""
    return sublevels.agg(F.sum("sublevels").alias("read_amp"))


def stabbing_depth(spans: DataFrame) -> DataFrame:
    """One row: the largest number of closed spans (smallest, largest) over one key, by prefix sums over their ends.

    At one key what begins comes before what ends.
    """
    at = lambda c, last, d: spans.select(F.struct(F.col(c).alias("at"), F.lit(last).alias("last")).alias("at"), F.lit(d).alias("d"))
    ends = at("smallest", 0, 1).union(at("largest", 1, -1)).groupBy("at").agg(F.sum("d").alias("d"))
    return prefix_sums(ends, "at", "d", "depth").agg(F.max("depth").alias("depth"))


def level_scores(levels: DataFrame, files_threshold: int = 500, depth_threshold: int = 4, base_level: int = 1, last_level: int = 6) -> DataFrame:
    """level, fill, compensated, score: which level is to be compacted first. A row per level goes through one window.

    levels has level, bytes, deletion_bytes (what pending deletions will free) and target bytes; level 0 has files and
    depth in place of sizes. A level's fill is its bytes over its target, at level 0 the larger of 2 * depth over the
    threshold and files over theirs. Levels whose compensated fill is below 1 score 0; the others' fill is divided by
    the next level's, 0.01 at least; level 0 also scores 0 if that is below 1. Levels between 0 and the base have none.
    """
    first = F.greatest(2 * F.col("depth") / depth_threshold, F.col("files") / files_threshold).cast("double")
    fill = F.when(F.col("level") == 0, first).otherwise(F.col("bytes") / F.col("target"))
    compensated = F.when(F.col("level") == 0, first).otherwise((F.col("bytes") + F.col("deletion_bytes")) / F.col("target"))
    rows = levels.select("level", fill.alias("fill"), compensated.alias("compensated"))
    below = rows.where(F.col("level") >= base_level).select(F.when(F.col("level") == base_level, 0).otherwise(F.col("level") - 1).alias("level"), F.col("fill").alias("below"))
    part = F.greatest(F.lit(0.01), F.coalesce("below", F.lit(0.0)))
    out = rows.where((F.col("level") == 0) | (F.col("level") >= base_level)).join(below, "level", "left")
    score = F.when(F.col("level") == last_level, F.col("fill")).otherwise(F.col("fill") / part)
    low = (F.col("compensated") < 1) | ((F.col("level") == 0) & (F.col("compensated") / part < 1))
    return out.select("level", "fill", "compensated", F.when(low, F.lit(0.0)).otherwise(score).alias("score"))


def deletion_estimates(files: DataFrame) -> DataFrame:
    """file_id, avg_value, ratio, freed: what a file's point deletions will free, from the file's totals and those of the
    lower files that it overlaps (`below_*`).

    files has file_id, bytes, raw_keys, raw_values, entries, deletions, sized_deletions, tombstone_keys, sized_hints and
    below_bytes, below_raw_keys, below_raw_values, below_entries, below_deletions.
    """
    both = lambda c: F.col(c) + F.col(f"below_{c}")
    held = both("entries") - both("deletions")
    value = both("raw_values") / F.greatest(held, F.lit(1))
    raw = both("raw_keys") + both("raw_values")
    ratio = F.when(raw == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both("bytes") / raw))
    key = F.when(F.col("deletions") == 0, F.lit(0.0)).otherwise(F.col("tombstone_keys") / F.col("deletions"))
    freed = (F.col("tombstone_keys") + F.col("sized_hints") + (F.col("deletions") - F.col("sized_deletions")) * (key + value)) * ratio
    return files.select("file_id", value.alias("avg_value"), ratio.alias("ratio"), F.when(F.col("deletions") == 0, 0).otherwise(F.floor(freed)).cast("long").alias("freed"))


def tiering(values: DataFrame, by: list[str], attribute: str, size: str, threshold: int) -> DataFrame:
    """Per group: total bytes, those without an attribute (0 or null), and of the rest those at or below the threshold
    (cold) and above. Counted, where a sketch would estimate."""
    has = F.coalesce(F.col(attribute) != 0, F.lit(False))
    of = lambda on, name: F.coalesce(F.sum(F.when(on, F.col(size))), F.lit(0)).alias(name)
    return values.groupBy(*by).agg(F.sum(size).alias("total"), of(~has, "no_attribute"), of(has & (F.col(attribute) <= threshold), "below"), of(has & (F.col(attribute) > threshold), "above"))


def ratio(over: Column, under: Column) -> Column:
    """0 when nothing is below."""
    return F.when(under == 0, F.lit(0.0)).otherwise(over / under)


def level_violations(log: DataFrame) -> DataFrame:
    """Per key, entries of a lower level that are newer than one of a level above, by an aggregate per key and level."""
    per = log.groupBy("key", "level").agg(F.min("seq").alias("least"), F.max("seq").alias("most"))
    w = Window.partitionBy("key").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)  # a row per level
    above = per.withColumn("_above", F.min("least").over(w)).where("most > _above").select("key", "level", "_above")
    return log.join(above, ["key", "level"]).where("seq > _above").drop("_above")


def span_bytes(files: DataFrame, lower: int, upper: int) -> DataFrame:
    """Files that overlap [lower, upper] with the bytes they hold in it; a file cut by a bound counts by its share of keys."""
    cut = F.expr(f"bytes * (least(largest, {upper}) - greatest(smallest, {lower}) + 1) div (largest - smallest + 1)")
    whole = (F.col("smallest") >= lower) & (F.col("largest") <= upper)
    return files.where((F.col("smallest") <= upper) & (F.col("largest") >= lower)).withColumn("span_bytes", F.when(whole, F.col("bytes")).otherwise(cut))


def categories(rows: DataFrame, key: str, bounds: list[tuple[object, str]]) -> Column:
    """The category of a key: the first whose upper bound (exclusive) is above it; the last has no bound (None)."""
    out = F.lit(None).cast("string")
    for upper, name in reversed(bounds):
        out = F.lit(name) if upper is None else F.when(F.col(key) < F.lit(upper), name).otherwise(out)
    return out


def category_range(start: object, end: object, bounds: list[tuple[object, str]]) -> str:
    """The name of a range's categories, `first-last`; an end at a bound counts the next category already."""
    at = lambda k: next(name for upper, name in bounds if upper is None or k < upper)
    first, last = at(start), at(end)
    return first if first == last else f"{first}-{last}"


# Lines of a maintenance log

#: How a line's time, node, store and job stand, how a size is written, and the three kinds of lines.
STAMP = r"(\d{6} \d{2}:\d{2}:\d{2}\.\d{6})"
CONTEXT = STAMP + r".*\[(?:T(?:\d+|\?),)?n(\d+|\?).*?,s(\d+|\?).*?\].*\[JOB (\d+)\] (.*)$"
SIZE = r"\(([0-9.]+) ?([KMGTPE]?)B?\)"
COMPACT, FLUSH = r"^compact(ed|ing)\((.*?)\)", r"^flush(ed|ing) \d+ memtables?"
INGESTED = r"L(\d):(\d+)(?:\(remote\))? \(([0-9.]+) ?([KMGTPE]?)B?\)"


def _bytes(number: Column, unit: Column) -> Column:
    power = F.when(unit == "", 0).otherwise(F.locate(unit, F.lit("KMGTPE")) if isinstance(unit, str) else F.instr(F.lit("KMGTPE"), unit))
    return F.round(number.cast("double") * F.pow(F.lit(1024.0), power)).cast("long")


def log_lines(lines: DataFrame) -> DataFrame:
    """node, store, job, at (timestamp), body of the lines (line) that tell of a job; others go."""
    part = lambda k: F.regexp_extract("line", CONTEXT, k)
    read = lines.where(F.col("line").rlike(CONTEXT))
    at = F.to_timestamp(F.concat(F.lit("20"), part(1)), "yyyyMMdd HH:mm:ss.SSSSSS")
    number = lambda k: F.when(part(k) == "?", None).otherwise(part(k)).cast("long")
    return read.select(number(2).alias("node"), number(3).alias("store"), part(4).cast("long").alias("job"), at.alias("at"), part(5).alias("body"))


def maintenance_events(lines: DataFrame) -> DataFrame:
    """node, store, job, type, from_level, to_level, began, ended, bytes_in, bytes_out of every job that the log shows
    whole: compactions by their type, flushes, and a row per ingested file (both times alike).

    A compaction's input is all that its first line lists, its output what stands behind the arrow of its last. Starts
    are paired with ends by node, store, job and kind.
    """
    read = log_lines(lines)
    parts = lambda col: F.zip_with(F.regexp_extract_all(col, F.lit(SIZE), 1), F.regexp_extract_all(col, F.lit(SIZE), 2), lambda n, u: _bytes(n, u))
    total = lambda col: F.aggregate(parts(col), F.lit(0).cast("long"), lambda a, b: a + b)
    names = ["node", "store", "job", "kind"]
    body = F.col("body")
    step = F.coalesce(F.nullif(F.regexp_extract("body", COMPACT, 1), F.lit("")), F.nullif(F.regexp_extract("body", FLUSH, 1), F.lit("")))
    kind = F.when(body.startswith("compact"), "compaction").otherwise("flush")
    jobs = read.where(body.rlike(COMPACT) | body.rlike(FLUSH)).withColumn("step", step).withColumn("kind", kind)
    levels = F.regexp_extract_all("body", F.lit(r"(?:^| )L(\d)(?= |$)"), 1)
    began = jobs.where("step = 'ing'").select(*names, F.col("at").alias("began"), F.regexp_extract("body", COMPACT, 2).alias("type"), levels.alias("levels"), total(body).alias("listed"))
    behind = F.substring_index("body", " -> ", -1)
    ended = jobs.where("step = 'ed'").select(
        *names, F.col("at").alias("ended"), F.when(F.col("kind") == "flush", F.get(parts(body), F.size(parts(body)) - 1)).when(body.contains(" -> "), total(behind)).alias("bytes_out"), levels.alias("last")
    )
    pairs = began.join(ended, names)
    flush = F.col("kind") == "flush"
    done = pairs.select(
        "node", "store", "job", F.when(flush, "flush").otherwise(F.col("type")).alias("type"),
        F.when(~flush, F.get("levels", F.lit(0)).cast("int")).alias("from_level"),
        F.when(flush, F.lit(0)).otherwise(F.get("last", F.size("last") - 1).cast("int")).alias("to_level"),
        "began", "ended", F.when(flush, F.lit(0)).otherwise(F.col("listed")).cast("long").alias("bytes_in"), F.coalesce("bytes_out", F.lit(0)).alias("bytes_out"),
    )
    each = lambda k: F.regexp_extract_all("body", F.lit(INGESTED), k)
    files = F.arrays_zip(each(1).alias("level"), each(3).alias("n"), each(4).alias("u"))
    taken = read.where(body.rlike(r"^ingested\s") | body.rlike(r"^flushed \d+ ingested flushable")).withColumn("f", F.explode(files))
    taken = taken.select(
        "node", "store", "job", F.lit("ingest").alias("type"), F.lit(None).cast("int").alias("from_level"), F.col("f.level").cast("int").alias("to_level"),
        F.col("at").alias("began"), F.col("at").alias("ended"), F.lit(0).cast("long").alias("bytes_in"), _bytes(F.col("f.n"), F.col("f.u")).alias("bytes_out"),
    )
    return done.unionByName(taken)


def maintenance_windows(events: DataFrame, seconds: int, long_seconds: int) -> DataFrame:
    """Per node, store, window, type and levels: n, bytes in, out, moved and deleted, seconds, long_running.

    A window begins at a multiple of its length; an event just at the end of a window in which others began stays in
    it. Moves and delete-only jobs have their bytes in columns of their own; a job is long if it takes more than the limit.
    """
    at = F.unix_micros("began")
    width = seconds * 1_000_000
    rows = events.withColumn("_w", F.floor(at / width)).withColumn("_edge", F.pmod(at, F.lit(width)) == 0)
    open_ = rows.where("not _edge").select("node", "store", (F.col("_w") + 1).alias("_w"), F.lit(True).alias("_open")).distinct()
    same = rows["node"].eqNullSafe(open_["node"]) & rows["store"].eqNullSafe(open_["store"]) & (rows["_w"] == open_["_w"]) & rows["_edge"]
    rows = rows.join(open_, same, "left").select(rows["*"], "_open")
    window = F.timestamp_seconds((F.col("_w") - F.coalesce(F.col("_open"), F.lit(False)).cast("int")) * seconds)
    took = (F.unix_micros("ended") - at) / 1e6
    of = lambda on, c: F.sum(F.when(on, F.col(c)).otherwise(0))
    move, drop = F.col("type") == "move", F.col("type") == "delete-only"
    return rows.groupBy("node", "store", window.alias("window"), "type", "from_level", "to_level").agg(
        F.count(F.lit(1)).alias("n"),
        of(~(move | drop), "bytes_in").alias("bytes_in"),
        of(~(move | drop), "bytes_out").alias("bytes_out"),
        of(move, "bytes_in").alias("bytes_moved"),
        of(drop, "bytes_in").alias("bytes_deleted"),
        F.sum(took).alias("seconds"),
        F.count_if(took > long_seconds).alias("long_running"),
    )


def manifest_summary(edits: DataFrame, seconds: int, last_level: int = 6) -> DataFrame:
    """bucket, level, added, compacted_in, files_in, compacted_out of a manifest's edits (edit_no, action, level,
    file_id, bytes, created_at in seconds); action is add, delete or backing.

    An edit that adds and deletes files and creates no backing is taken for a compaction; the bytes of another are
    added. A compaction within level 0 counts nowhere, and what leaves the last level isn't counted as out. An edit's
    bucket is that of the newest creation time so far; the first edit, and edits before any time, are left out.
    """
    of = lambda a: F.max((F.col("action") == a).cast("int")) == 1
    per = edits.groupBy("edit_no").agg(
        (of("add") & of("delete") & ~of("backing")).alias("compaction"),
        F.max(F.when((F.col("action") == "add") & (F.col("created_at") > 0), F.col("created_at"))).alias("created"),
        F.min_by("level", F.when(F.col("action") == "add", F.col("file_id"))).alias("first"),
    )
    dealt = ranked(per, "edit_no", "n")
    # the newest time so far: a running maximum, as the last of the edits that raise it
    newest = _running_max(dealt, "n", "created", "newest")
    bucket = F.timestamp_seconds(F.floor(F.col("newest") / seconds) * seconds)
    named = newest.where("n > 0 and newest is not null").select("edit_no", bucket.alias("bucket"), "compaction", (F.col("compaction") & (F.col("first") == 0)).alias("inner"))
    sizes = edits.where("action = 'add'").groupBy("file_id").agg(F.max_by("bytes", "edit_no").alias("known"))
    rows = edits.where("action in ('add', 'delete')").join(named, "edit_no").join(sizes, "file_id", "left")
    added, moved = F.col("action") == "add", F.col("compaction") & ~F.col("inner")
    sum_ = lambda on, v: F.sum(F.when(on, v).otherwise(0))
    return rows.groupBy("bucket", "level").agg(
        sum_(added & ~F.col("compaction"), F.col("bytes")).alias("added"),
        sum_(added & moved, F.col("bytes")).alias("compacted_in"),
        F.count_if(added & moved).alias("files_in"),
        sum_(~added & moved & (F.col("level") != last_level), F.coalesce("known", F.lit(0))).alias("compacted_out"),
    )


def _running_max(df: DataFrame, order: str, value: str, name: str, run: int = 1 << 16) -> DataFrame:
    """df, whose `order` counts from 0, with the largest value up to each row: runs of rows, then a row per run."""
    rows = df.withColumn("_run", F.floor(F.col(order) / run))
    inside = Window.partitionBy("_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)  # a row per run
    runs = rows.groupBy("_run").agg(F.max(value).alias("_top")).select("_run", F.max("_top").over(before).alias("_past"))
    return rows.withColumn("_in", F.max(value).over(inside)).join(runs, "_run").withColumn(name, F.greatest("_in", "_past")).drop("_run", "_in", "_past")


def live_counts(edits: DataFrame) -> DataFrame:
    """edit_no, level, live: files of a level after each edit that touches it; edits (edit_no, level, d: +1 or -1)."""
    per = edits.groupBy("level", "edit_no").agg(F.sum("d").alias("d")).withColumn("_by", F.struct("level", "edit_no"))
    summed = prefix_sums(per, "_by", "d", "_all")
    base = per.groupBy("level").agg(F.sum("d").alias("_sum"))
    ahead = base.select("level", (F.sum("_sum").over(Window.orderBy("level")) - F.col("_sum")).alias("_ahead"))  # a row per level
    return summed.join(F.broadcast(ahead), "level").select("edit_no", "level", (F.col("_all") - F.col("_ahead")).alias("live"))


def order_violations(rows: DataFrame, file_col: str, key: str, order: list[str]) -> DataFrame:
    """Per file its entries, and those that stand after a larger key."""
    before = F.lag(key).over(Window.partitionBy(file_col).orderBy(*order))
    return rows.withColumn("_before", before).groupBy(file_col).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_before") > F.col(key)).alias("unsorted"))


def table_properties(rows: DataFrame, by: str, key: str, prefix: str) -> DataFrame:
    """Per file or level: entries, bounds, distinct prefixes."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("smallest"), F.max(key).alias("largest"), F.countDistinct(prefix).alias("n_prefixes"))


def value_summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group: median, 90th percentile, mean and sample deviation."""
    return rows.groupBy(*by).agg(
        F.expr(f"percentile({value}, 0.5)").alias("p50"), F.expr(f"percentile({value}, 0.9)").alias("p90"),
        F.round(F.avg(value), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 6).alias("stddev"),
    )


def weighted_summary(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Per group the weighted mean and deviation (by the sum of weights less one), from three sums that merge in any order."""
    w, x = F.col(weight), F.col(value)
    n, s, q = F.sum(w), F.sum(w * x), F.sum(w * x * x)
    spread = F.when(n > 1, F.sqrt(F.greatest((q - s * s / n) / (n - 1), F.lit(0.0)))).otherwise(F.lit(0.0))
    return rows.groupBy(*by).agg(F.when(n > 0, s / n).otherwise(F.lit(0.0)).alias("mean"), spread.alias("stddev"), n.alias("weight"))


def rate_deltas(rows: DataFrame, key: str, order: str, value: str) -> Column:
    """What a counter grew by since its last sample; a fall counts as 0."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return F.greatest(F.col(value) - before, F.lit(0))


def sampled(rows: DataFrame, at: str, value: str, buckets: int) -> DataFrame:
    """bucket, value: n equal parts of the samples' time, the latest value of each; an empty one takes the next value."""
    ends = rows.agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    own = rows.withColumn("_e", ends.select(F.struct("lo", "hi")).scalar())
    width = F.greatest(F.col("_e.hi") - F.col("_e.lo"), F.lit(1))
    part = F.least(F.floor((F.col(at) - F.col("_e.lo")) * buckets / width), F.lit(buckets - 1))
    last = own.groupBy(part.cast("int").alias("bucket")).agg(F.max_by(value, at).alias("value"))
    every = rows.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(last, "bucket", "left")
    next_ = Window.orderBy("bucket").rowsBetween(0, Window.unboundedFollowing)  # a row per bucket
    return every.select("bucket", F.first("value", True).over(next_).alias("value"))
