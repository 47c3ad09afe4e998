"""Interval joins, merges and coordinates. Intervals are closed [lo, hi], regions half-open [start, stop), per chrom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.ordered import carry, ranged, within

#: Bins that one interval may cover before it takes a wider kind of bin.
MOST_BINS = 8


def stab_join(points: DataFrame, intervals: DataFrame, *, on: str = "chrom", point: str = "pos", lo: str = "lo", hi: str = "hi", bin_width: int = 4096, how: str = "inner") -> DataFrame:
    """Every (point, interval) with lo <= point <= hi on the same chrom, each once; how: inner or left_semi.

    An equi-join on bins: an interval is spread over the bins that it touches, at a width at which these are few,
    and a point looks into its bin of every width that intervals use (a handful, doubling in powers of 8). So long
    intervals cost as little as short ones, and adaptive execution splits crowded bins. Nulls match nothing;
    an interval with hi < lo holds nothing; equal intervals and equal points all count.
    """
    span = F.col(hi) - F.col(lo)
    kept = intervals.where(span >= 0)
    # Level: how many times the width is taken by 8 until the interval touches few bins.
    level = F.greatest(F.lit(0), F.ceil(F.log(8.0, F.greatest(F.lit(1.0), span / F.lit(float(bin_width * (MOST_BINS - 1)))))).cast("int"))
    width = F.lit(bin_width).cast("long") * F.pow(F.lit(8.0), F.col("_level")).cast("long")
    binned = kept.withColumn("_level", level).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    levels = [row["_level"] for row in kept.select(level.alias("_level")).distinct().collect()]  # at most 21: powers of 8 in 64 bits
    if not levels:
        levels = [0]
    looked = F.explode(F.array(*(F.struct(F.lit(n).alias("_level"), F.floor(F.col(point) / F.lit(bin_width * 8**n)).alias("_bin")) for n in sorted(levels))))
    spread = points.withColumn("_look", looked).withColumn("_level", F.col("_look._level")).withColumn("_bin", F.col("_look._bin")).drop("_look")
    if how == "left_semi":  # a point looks into each level once, so one row may match in several
        slim = binned.select(F.col(on).alias("_on"), F.col("_level").alias("_l"), F.col("_bin").alias("_b"), F.col(lo).alias("_lo"), F.col(hi).alias("_hi"))
        inside = (F.col(on) == F.col("_on")) & (F.col("_level") == F.col("_l")) & (F.col("_bin") == F.col("_b")) & F.col(point).between(F.col("_lo"), F.col("_hi"))
        return points.join(spread.join(slim, inside, "left_semi").select(on, point).distinct(), [on, point], "left_semi")
    taken = set(points.columns) - {on}
    clash = [c for c in intervals.columns if c in taken]
    if clash:
        raise ValueError(f"both sides have columns {clash}")
    return spread.join(binned, [on, "_level", "_bin"]).where(F.col(point).between(F.col(lo), F.col(hi))).drop("_level", "_bin")


def in_regions(points: DataFrame, regions: DataFrame, *, on: str = "chrom", point: str = "pos", start: str = "start", stop: str = "stop", bin_width: int = 65536) -> DataFrame:
    """The points that lie in a region [start, stop)."""
    closed = regions.select(on, F.col(start).alias("_from"), (F.col(stop) - 1).alias("_to"))
    return stab_join(points, closed, on=on, point=point, lo="_from", hi="_to", bin_width=bin_width, how="left_semi")


def _islands(rows: DataFrame, keys: list[str], first: str, opens: Column, *order: str) -> DataFrame:
    """rows with _first, the value of a column in the row that opened the island they belong to, in any range."""
    opened = F.max(F.when(F.col("_opens"), F.col(first)))
    marked = rows.withColumn("_opens", opens)
    local = marked.withColumn("_own", opened.over(within(keys, *order)))
    carried = carry(local, keys, _earlier_first=(opened, "max"))
    return carried.withColumn("_first", F.coalesce("_own", "_earlier_first")).drop("_opens", "_own", "_earlier_first")


def merge_regions(df: DataFrame, *, on: str | list[str] = "chrom", start: str = "start", stop: str = "stop") -> DataFrame:
    """The union of regions: what overlaps or touches becomes one row of on, start, stop.

    A scan over ranges: how far earlier regions reach is carried from one range to the next.
    """
    keys = [on] if isinstance(on, str) else on
    distinct = df.select(*keys, start, stop).where(F.col(start).isNotNull() & F.col(stop).isNotNull()).distinct()
    rows = ranged(distinct, *keys, start, stop)
    before = within(keys, start, stop).rowsBetween(Window.unboundedPreceding, -1)
    reached = carry(rows.withColumn("_reached", F.max(stop).over(before)), keys, _carried=(F.max(stop), "max"))
    most = F.greatest("_reached", "_carried")
    islands = _islands(reached, keys, start, most.isNull() | (F.col(start) > most), start, stop)
    return islands.groupBy(*keys, "_first").agg(F.max(stop).alias(stop)).select(*keys, F.col("_first").alias(start), stop)


def coalesce_runs(df: DataFrame, *, by: list[str], pos: str = "pos", width: int = 1) -> DataFrame:
    """Runs of consecutive positions: by, lo, hi, where hi is the last position + width - 1 (0-based and closed).

    A scan over ranges: the last position and the open run are carried from one range to the next.
    """
    rows = ranged(df.select(*by, pos).distinct(), *by, pos)
    before = carry(rows.withColumn("_last", F.lag(pos).over(within(by, pos))), by, _carried=(F.max(pos), "max"))
    last = F.coalesce("_last", "_carried")
    runs = _islands(before, by, pos, last.isNull() | (F.col(pos) != last + 1), pos)
    return runs.groupBy(*by, "_first").agg((F.max(pos) + width - 1).alias("hi")).select(*by, F.col("_first").alias("lo"), "hi")


def half_open(df: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Closed intervals as regions [start, stop)."""
    return df.withColumn("start", F.col(lo)).withColumn("stop", F.col(hi) + 1).drop(lo, hi)


def dense_ranks(df: DataFrame, *columns: str, on: str | None = None) -> DataFrame:
    """Distinct coordinates of the columns with rank (from 0) and gapped, the rank in which each gap has a cell too.

    With on, separately for each of its values. Before the first coordinate there is one gap cell, hence gapped
    starts at 1.
    """
    keys = [on] if on else []
    coordinates = None
    for c in columns:
        one = df.select(*keys, F.col(c).alias("coordinate"))
        coordinates = one if coordinates is None else coordinates.unionByName(one)
    rows = ranged(coordinates.where(F.col("coordinate").isNotNull()).distinct(), *keys, "coordinate")
    order = within(keys, "coordinate")
    before = carry(rows.withColumn("_last", F.lag("coordinate").over(order)), keys, _carried=(F.max("coordinate"), "max"))
    last = F.coalesce("_last", "_carried")
    gaps = before.withColumn("_gap", F.when(last.isNull() | (last + 1 < F.col("coordinate")), 1).otherwise(0))
    local = gaps.withColumns({"_place": F.row_number().over(order), "_gaps": F.sum("_gap").over(order)})
    whole = carry(local, keys, _rows=(F.count("*"), "sum"), _holes=(F.sum("_gap"), "sum"))
    rank = F.col("_place") - 1 + F.coalesce("_rows", F.lit(0))
    gapped = rank + F.col("_gaps") + F.coalesce("_holes", F.lit(0))
    return whole.select(*keys, "coordinate", rank.cast("long").alias("rank"), gapped.cast("long").alias("gapped"))


def sparse_to_dense(points: DataFrame, ranks: DataFrame, point: str = "pos", on: str | None = None, bin_width: int = 4096) -> DataFrame:
    """points with gapped: that of the coordinate itself, or of the gap cell before the next one above.

    ranks is what dense_ranks gives, for each value of on if that is named. Coordinates become intervals up to the
    next one, which points are joined to by bins, so no task holds all points. Null points give no rows.
    """
    keys = [on] if on else []
    key = F.col(on) if on else F.lit(0)
    own = ranks.select(key.alias("_on"), "coordinate", "gapped", "rank")
    following = own.select(F.col("_on").alias("_of"), (F.col("rank") - 1).alias("_rank"), (F.col("coordinate") - 1).alias("_to"))
    inner = own.join(following, F.col("_on").eqNullSafe(F.col("_of")) & (F.col("rank") == F.col("_rank"))).select("_on", "coordinate", "gapped", "_to")
    ends = own.groupBy("_on").agg(F.min("coordinate").alias("_least"), F.max(F.struct("coordinate", "gapped")).alias("_last"))
    asked = points.select(*keys, F.col(point).alias("_point")).distinct().where(F.col("_point").isNotNull())
    asked = asked.withColumn("_on", key).drop(*keys)
    found = stab_join(asked, inner, on="_on", point="_point", lo="coordinate", hi="_to", bin_width=bin_width)
    cell = lambda c, g: F.when(c == F.col("_point"), g).otherwise(g + 1)
    between = found.select("_on", "_point", cell(F.col("coordinate"), F.col("gapped")).alias("gapped"))
    beyond = asked.join(ends, "_on", "left").where(F.col("_least").isNull() | (F.col("_point") < F.col("_least")) | (F.col("_point") >= F.col("_last.coordinate")))
    outer = F.when(F.col("_point") >= F.col("_last.coordinate"), cell(F.col("_last.coordinate"), F.col("_last.gapped"))).otherwise(0)
    cells = between.unionByName(beyond.select("_on", "_point", outer.cast("long").alias("gapped")))
    joined = points.join(cells, (key == F.col("_on")) & (F.col(point) == F.col("_point")))
    return joined.select(*points.columns, "gapped")


def having_min_hits(hits: DataFrame, by: list[str], least: int) -> DataFrame:
    """by, hits of the groups that are hit at least so often, repeated hits included."""
    return hits.groupBy(*by).agg(F.count("*").alias("hits")).where(F.col("hits") >= least)
