"""Gesture search: nearest windows, channel statistics, and time-warped matching."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideframe.operators import scans, spatial, warping
from strideframe.operators.warping import closed_dtw, closed_ends  # noqa: F401

STD_FLOOR = 1e-6
#: Starts of a window block at least, and about how many values of references and of clips meet in one group.
BLOCK_STARTS = 256
GROUP_VALUES = 400_000
#: About how many pairs of a reference and a clip meet in one group, where all are returned and where the best few are.
GROUP_PAIRS, TOP_PAIRS = 1_000_000, 2_000_000
#: Groups at least, so that a small table spreads over the tasks too.
FEWEST_GROUPS, MOST_PARTS = 24, 20_000


def nearest_windows(queries: DataFrame, windows: DataFrame, axes: list[str], k: int = 10) -> DataFrame:
    """The ``k`` windows nearest to each query row (query_id and ``axes``), with distance and rank: exact, by an index of cells."""
    return spatial.nearest(queries, windows, axes, k, [c for c in ("clip_id", "window_index") if c in windows.columns])


def channel_stats(signals: DataFrame, channels: list[str]) -> DataFrame:
    """clip_id, channel, mean (0 if none), std (1 if none or next to 0) and raw_std of each reference channel."""
    long = _long(signals.filter("is_reference"), channels)
    return long.groupBy("clip_id", "channel").agg(
        F.coalesce(F.avg("v"), F.lit(0.0)).alias("mean"),
        F.when(F.stddev_pop("v") > STD_FLOOR, F.stddev_pop("v")).otherwise(1.0).alias("std"),
        F.coalesce(F.stddev_pop("v"), F.lit(0.0)).alias("raw_std"),
    )


def _long(signals: DataFrame, channels: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("v")) for c in channels])
    return signals.select("clip_id", F.explode(pairs).alias("p")).select("clip_id", "p.channel", "p.v")


def global_channel_scale(signals: DataFrame, channels: list[str]) -> DataFrame:
    """channel, scale: the deviation over all reference samples; 1 if none or next to 0."""
    return _long(signals.filter("is_reference"), channels).groupBy("channel").agg(
        F.when(F.stddev_pop("v") > STD_FLOOR, F.stddev_pop("v")).otherwise(1.0).alias("scale")
    )


def channel_weights(signals: DataFrame, channels: list[str]) -> DataFrame:
    """clip_id, channel, weight: a reference's deviations (0 for a flat channel) in units of the global ones, summing to 1 (all 0 if they do)."""
    ratio = channel_stats(signals, channels).join(global_channel_scale(signals, channels), "channel").withColumn("ratio", F.col("raw_std") / F.col("scale"))
    total = F.sum("ratio").over(Window.partitionBy("clip_id"))
    return ratio.select("clip_id", "channel", F.coalesce(F.try_divide("ratio", total), F.lit(0.0)).alias("weight"))


def weight_report(weights: DataFrame) -> DataFrame:
    """Each reference's channels by descending weight, with their place."""
    place = F.row_number().over(Window.partitionBy("clip_id").orderBy(F.desc("weight"), "channel"))
    return weights.withColumn("place", place).orderBy("clip_id", "place")


def channel_zscores(signals: DataFrame, stats: DataFrame, reference_id: str, channels: list[str]) -> DataFrame:
    """Channels in a reference's units; missing values become 0."""
    mine = stats.filter(F.col("clip_id") == reference_id)
    wide = mine.groupBy().pivot("channel", channels).agg(F.first("mean").alias("m"), F.first("std").alias("s"))
    keep = [c for c in signals.columns if c not in channels]
    joined = signals.join(F.broadcast(wide), how="inner")  # one row
    return joined.select(*keep, *[F.coalesce((F.col(c) - F.col(f"{c}_m")) / F.col(f"{c}_s"), F.lit(0.0)).alias(c) for c in channels])


def best_matches(
    query: np.ndarray, series: list[np.ndarray], weights: np.ndarray, block: int = 256, firsts: list[int] | None = None, starts: int | None = None
) -> list[tuple[int, int, float] | None]:
    """For each series the best (start, length, cost per step); ties go to the shorter, then the earlier window.

    A series may be part of a longer one: it begins at frame ``firsts[k]`` of it, and windows begin in its first ``starts`` frames.
    """
    m, c = query.shape
    lengths, stride = warping.window_lengths(m), warping.window_stride(m)
    sizes = np.array([len(x) for x in series], np.int64)
    joined = np.concatenate([*series, np.zeros((lengths[-1], c))]).T
    base = np.cumsum(sizes) - sizes
    first = [np.arange(-(firsts[k] if firsts else 0) % stride, min(len(x) - lengths[0] + 1, starts or len(x)), stride) for k, x in enumerate(series)]
    own, spot = np.repeat(np.arange(len(series)), [len(x) for x in first]), np.concatenate([*first, np.zeros(0, np.int64)]).astype(np.int64)
    room = sizes[own] - spot
    costs = np.full((len(lengths), len(own)), np.inf)
    alike = np.argsort(np.minimum(room, lengths[-1]), kind="stable")  # windows of like length side by side: a block is as long as its longest
    for lo in range(0, len(own), block):
        part = alike[lo : lo + block]
        longest = min(lengths[-1], int(room[part].max()))
        some = [n for n in lengths if n <= longest]
        at = (base[own[part]] + spot[part])[None, :] + np.arange(longest)[:, None]
        found = closed_ends(query, joined[:, at], weights, some) / (m + np.array(some))[:, None]
        costs[: len(some), part] = np.where(room[part][None] >= np.array(some)[:, None], found, np.inf)
    ends = np.searchsorted(own, np.arange(len(series) + 1))
    best: list[tuple[int, int, float] | None] = []
    for a, b in zip(ends[:-1], ends[1:]):
        i = int(costs[:, a:b].argmin()) if b > a else 0  # by length, then by start
        k, j = divmod(i, int(b - a)) if b > a else (0, 0)
        best.append((int(spot[a + j]), lengths[k], float(costs[k, a + j])) if b > a and np.isfinite(costs[k, a + j]) else None)
    return best


MATCH = "reference_id string, clip_key long, clip_id string, start long, window_length_frames long, start_frame long, end_frame long, normalized_cost double"


def dtw_matches(signals: DataFrame, channels: list[str], references: list[str] | None = None, k: int | None = None) -> DataFrame:
    """The best window of every clip that is not a reference, for each reference; frame_index counts a clip's frames from 0. With ``k``, at
    least the rows of the ``k`` best clips of each reference (``top_matches`` leaves just these), which saves most of the work.

    References of like length make a class. For each class the clips are cut into overlapping window
    blocks, and groups of blocks meet groups of references, each of about GROUP_VALUES values; a group is
    larger only where one reference, or one block of a few times its length, is. The best windows of the
    blocks are then reduced to one of each reference and clip.
    """
    chosen = signals.filter("is_reference")
    if references is not None:
        chosen = chosen.filter(F.col("clip_id").isin(references))
    values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in channels])
    scale = channel_stats(chosen, channels).join(channel_weights(signals, channels), ["clip_id", "channel"]).groupBy("clip_id").agg(
        F.map_from_entries(F.collect_list(F.struct("channel", F.struct("mean", "std", "weight")))).alias("of")
    ).select("clip_id", *[F.array(*[F.col("of")[c][x] for c in channels]).alias(x) for x in ("mean", "std", "weight")])
    sizes = chosen.groupBy("clip_id").agg(F.count("*").alias("m")).withColumn("longest", F.expr("shiftleft(1L, length(bin(m - 1)))"))
    clips = signals.filter("not is_reference")
    n_frames, n_clips, most_frames = clips.groupBy("clip_key", "clip_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    classes, ahead = [], 0
    for r in sizes.groupBy("longest").agg(F.sum("m").alias("frames"), F.count("*").alias("refs")).orderBy("longest").collect():  # one row a power of two
        starts = max(BLOCK_STARTS, r["longest"])
        blocks = n_clips + n_frames // starts
        values_of_clips = (n_frames + 2 * r["longest"] * (n_frames // starts)) * len(channels)
        classes.append((r["longest"], starts, *_groups(r["refs"], r["frames"] * len(channels), blocks, values_of_clips, GROUP_PAIRS if k is None else TOP_PAIRS), ahead, r["refs"]))
        ahead += r["refs"]
    known = signals.sparkSession.createDataFrame(classes, "longest long, starts long, n_refs long, n_clips long, ahead long, refs long")
    placed = scans.ranked(sizes, ["longest", "m", "clip_id"], "place")  # references of equal length side by side: a group makes its tables once a length
    in_order = lambda c: F.array_sort(F.collect_list(F.struct("frame_index", *c)))
    wide = (
        chosen.select("clip_id", "frame_index", values.alias("v")).groupBy("clip_id").agg(in_order(["v"]).alias("f"))
        .join(placed.select("clip_id", "longest", "place"), "clip_id").join(scale, "clip_id").join(F.broadcast(known), "longest")
        .select(
            "longest", F.expr("(place - 1 - ahead) * n_refs div refs").alias("ref_group"), F.explode(F.expr("sequence(0L, n_clips - 1)")).alias("clip_group"),
            F.col("clip_id").alias("reference_id"), F.flatten("f.v").alias("v"), "mean", "std", "weight",
        )
    )
    block = F.explode(F.expr("sequence(greatest(0L, cast(floor((frame_index - starts - 2 * longest) / starts) as long) + 1), cast(floor(frame_index / starts) as long))"))
    blocks = (
        clips.select(F.col("clip_key").cast("long").alias("clip_key"), "clip_id", F.col("frame_index").cast("long").alias("frame_index"), F.col("frame_number").cast("long").alias("frame_number"), values.alias("v"))
        .crossJoin(F.broadcast(known)).withColumn("block", block)
        .groupBy("longest", "starts", "n_refs", "n_clips", "clip_key", "clip_id", "block").agg(in_order(["frame_number", "v"]).alias("f"))
        .select(
            "longest", F.explode(F.expr("sequence(0L, n_refs - 1)")).alias("ref_group"), F.pmod(F.xxhash64("clip_key", "block"), "n_clips").alias("clip_group"),
            "clip_key", "clip_id", "starts", (F.col("block") * F.col("starts")).alias("first"), F.col("f.frame_number").alias("numbers"), F.flatten("f.v").alias("v"),
        )
    )
    keys = ["longest", "ref_group", "clip_group"]
    # partitions for single groups, more than there are groups so that few share one: the tables are small for the work in them, and
    # adaptive execution would put them in one task
    n_parts = min(MOST_PARTS, 4 * sum(c[2] * c[3] for c in classes)) or 1
    wide, blocks = wide.repartition(n_parts, *keys), blocks.repartition(n_parts, *keys)
    n_channels = len(channels)
    found = wide.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInArrow(lambda refs, clips: _scan(refs, clips, n_channels, k), MATCH)
    if k is None and most_frames <= BLOCK_STARTS:
        return found  # each clip is one block
    names = [x.split()[0] for x in MATCH.split(", ")]
    order = F.struct("normalized_cost", "window_length_frames", "start")
    best = found.groupBy("reference_id", "clip_key", "clip_id").agg(F.min_by(F.struct(*names[3:]), order).alias("best"))
    return best.select(*names[:3], "best.*")


def _groups(refs: int, ref_values: int, blocks: int, block_values: int, pairs: int) -> tuple[int, int]:
    """Groups of references and of window blocks: of bounded values and pairs, and enough of them for all tasks."""
    n_refs, n_clips = 1 + ref_values // GROUP_VALUES, 1 + block_values // GROUP_VALUES
    n_refs = max(n_refs, min(refs, -(-FEWEST_GROUPS // n_clips)))
    n_clips = max(n_clips, min(max(1, blocks), -(-FEWEST_GROUPS // n_refs)))
    more = (refs * blocks / (n_refs * n_clips * pairs)) ** 0.5
    return (int(-(-n_refs * more // 1)), int(-(-n_clips * more // 1))) if more > 1 else (n_refs, n_clips)


def _rows(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column."""
    column = column.combine_chunks()
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(column.flatten().to_numpy(zero_copy_only=False), ends[:-1])


def _scan(refs: pa.Table, clips: pa.Table, n_channels: int, k: int | None) -> pa.Table:
    """The best windows of a group of window blocks for a group of references: one of each clip, or of the ``k`` best clips of each reference."""
    parts: list[tuple[np.ndarray, warping.Best]] = []
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
    if refs.num_rows and clips.num_rows:
        series = [x.reshape(-1, n_channels) for x in _rows(clips["v"])]
        firsts, starts = clips["first"].to_numpy(), int(clips["starts"][0].as_py())
        names = clips.select(["clip_key", "clip_id"]).to_pandas()
        clip_of = names.groupby(["clip_key", "clip_id"], sort=False, dropna=False).ngroup().to_numpy()
        by_name = np.unique(names["clip_id"].to_numpy().astype(str), return_inverse=True)[1]
        raw, *scales = ([_rows(refs[c]) for c in ("v", "mean", "std", "weight")])
        lengths = np.array([len(x) // n_channels for x in raw])
        for m in np.unique(lengths).tolist():
            laid = warping.Laid(series, m, firsts, starts)
            tables = laid.tables(np.uint16 if n_channels == 1 else np.float64) if laid.fits() else None
            for r in np.flatnonzero(lengths == m).tolist():
                mean, std, weights = (x[r] for x in scales)
                query = warping.scored(raw[r].reshape(m, n_channels).T, mean, std).T
                if tables is None:
                    hits = best_matches(query, [warping.scored(x.T, mean, std).T for x in series], weights, firsts=firsts.tolist(), starts=starts)
                    some = [(i, *h) for i, h in enumerate(hits) if h]
                    found = warping.Best(*[np.array(x, t) for x, t in zip(zip(*some), (int, int, int, float))]) if some else warping.NONE
                elif n_channels == 1:
                    found = warping.screened(laid, tables, query, weights, mean, std, clip_of, k)
                else:
                    found = warping.every_best(laid, tables, query, weights, mean, std)
                found = warping.one_each(clip_of[found.series], found._replace(start=found.start + firsts[found.series]))
                if k is not None:
                    order = np.lexsort((by_name[found.series], found.cost))[:k]
                    found = warping.Best(*[x[order] for x in found])
                parts.append((np.full(len(found.series), r), found))
    if not parts:
        return pa.table({n: pa.array([], kinds[t]) for n, t in (x.split() for x in MATCH.split(", "))})
    ref = np.concatenate([r for r, _ in parts])
    found = warping.Best(*[np.concatenate(x) for x in zip(*[f for _, f in parts])])
    sizes = np.array([len(x) for x in series])
    numbers = clips["numbers"].combine_chunks().flatten()
    at = (np.cumsum(sizes) - sizes - firsts)[found.series] + found.start
    of = pa.array(found.series)
    columns = [
        refs["reference_id"].combine_chunks().take(pa.array(ref)), clips["clip_key"].combine_chunks().take(of), clips["clip_id"].combine_chunks().take(of),
        pa.array(found.start), pa.array(found.length), numbers.take(pa.array(at)), numbers.take(pa.array(at + found.length - 1)), pa.array(found.cost),
    ]
    return pa.table(dict(zip([x.split()[0] for x in MATCH.split(", ")], columns)))


def top_matches(matches: DataFrame, k: int = 5) -> DataFrame:
    """The best ``k`` clips of each reference, with rank."""
    rank = F.row_number().over(Window.partitionBy("reference_id").orderBy("normalized_cost", "clip_id"))
    return matches.withColumn("rank", rank).filter(F.col("rank") <= k)


def match_overlay(signals: DataFrame, matches: DataFrame, channels: list[str]) -> DataFrame:
    """Frames of each match with their fractional progress through it."""
    hit = matches.select("reference_id", "clip_key", F.col("start").alias("_s"), F.col("window_length_frames").alias("_n"))
    i = F.col("frame_index") - F.col("_s")
    return signals.join(hit, "clip_key").filter((i >= 0) & (i < F.col("_n"))).select(
        "reference_id", "clip_key", "frame_index", F.coalesce(F.try_divide(i.cast("double"), F.col("_n") - 1), F.lit(0.0)).alias("progress"), *channels
    )


def overlay_channels(signals: DataFrame, matches: DataFrame, channels: list[str]) -> DataFrame:
    """reference_id, clip_key (null for the reference itself), progress and the channels in the reference's units, missing ones 0:
    the frames of each match beside those of its reference."""
    stats = channel_stats(signals, channels).groupBy("clip_id").pivot("channel", channels).agg(F.first("mean").alias("m"), F.first("std").alias("s"))
    stats = stats.withColumnRenamed("clip_id", "reference_id")
    found = match_overlay(signals, matches, channels).drop("frame_index")
    n = F.count("*").over(Window.partitionBy("clip_id"))
    own = signals.filter("is_reference").join(matches.select(F.col("reference_id").alias("clip_id")).distinct(), "clip_id", "left_semi").select(
        F.col("clip_id").alias("reference_id"), F.lit(None).cast(found.schema["clip_key"].dataType).alias("clip_key"),
        F.coalesce(F.try_divide(F.col("frame_index").cast("double"), n - 1), F.lit(0.0)).alias("progress"), *channels,
    )
    z = [F.coalesce((F.col(c) - F.col(f"{c}_m")) / F.col(f"{c}_s"), F.lit(0.0)).alias(c) for c in channels]
    return found.union(own).join(stats, "reference_id").select("reference_id", "clip_key", "progress", *z)


def match_table(matches: DataFrame, clips: DataFrame, k: int = 5) -> DataFrame:
    """The best ``k`` clips of each reference with the columns of ``clips`` (clip_id, participant_id, school, ...)."""
    return top_matches(matches, k).join(clips, "clip_id", "left")


def convex_hull(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Hull corners of each group of points, counter-clockwise; none for fewer than three points or a line.

    Hulls of salted parts are taken first, so a group of any size is cut down before its corners meet.
    """
    def hull(pdf: pd.DataFrame) -> pd.DataFrame:
        pts = sorted(set(zip(pdf[x].tolist(), pdf[y].tolist())))

        def half(points):
            out: list[tuple[float, float]] = []
            for p in points:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(p)
            return out[:-1]

        corners = half(pts) + half(pts[::-1]) if len(pts) >= 3 else []
        if len(corners) < 3:
            corners = []
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(corners), "corner": range(len(corners)), x: [p[0] for p in corners], y: [p[1] for p in corners]})

    kind = points.select(key).schema[0].dataType.simpleString()
    # hulls of parts first, then the hull of their corners
    schema = f"{key} {kind}, corner int, {x} double, {y} double"
    parts = points.select(key, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y), F.pmod(F.xxhash64(x, y), F.lit(64)).alias("_salt"))
    few = parts.groupBy(key, "_salt").applyInPandas(lambda pdf: _or_all(hull(pdf), pdf, key, x, y), schema)
    return few.groupBy(key).applyInPandas(hull, schema)


def _or_all(corners: pd.DataFrame, pdf: pd.DataFrame, key: str, x: str, y: str) -> pd.DataFrame:
    """The corners of a part; a part without a hull passes its end points (they may be corners of the whole)."""
    if len(corners):
        return corners
    ends = pdf.sort_values([x, y]).iloc[[0, -1]].drop_duplicates([x, y])
    return pd.DataFrame({key: ends[key], "corner": 0, x: ends[x], y: ends[y]})
