"""Merging detections; smoothing and gap filling within clips of bounded length (``scans`` has the forms for any length)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions.expr import AXES, finite


def collapse_duplicates(long: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The first present value of each key by ``order``."""
    return long.groupBy(*keys).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias(value))


def whole(k: Column, dims: int = 2) -> Column:
    """Whether a keypoint is present in all coordinates and likelihood."""
    return reduce(lambda a, b: a & b, [finite(k[a]).isNotNull() for a in (*AXES[:dims], "lik")])


def first_available(points: list[Column], dims: int = 2) -> Column:
    """The first keypoint that is whole, by fixed priority; likelihoods are not compared."""
    return F.coalesce(*[F.when(whole(p, dims), p) for p in points])


def merge_sources(sources: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """Full outer alignment of sources on ``key``, and the first present value in the order of ``sources``."""
    named = [df.select(key, F.col(value).alias(f"{name}_{value}")) for name, df in sources.items()]
    joined = reduce(lambda a, b: a.join(b, key, "full_outer"), named)
    return joined.withColumn(value, F.coalesce(*[F.col(f"{n}_{value}") for n in sources]))


def merge_pose_sources(body: DataFrame, full_body: DataFrame, hand: DataFrame, n_body: int = 17, n_hand: int = 42) -> DataFrame:
    """frame_number, kp of body and hand joints. Each input has frame_number and an array ``kp``: body
    (n_body), full_body (n_body + n_hand) and hand (n_hand, left then right). Body joints prefer the body
    model, hand joints the hand model, then full_body. The hand roots (first of each hand) follow the body
    wrists instead: body wrist, full_body hand root, full_body wrist; the hand model's own root is unused."""
    names = {"b": body, "f": full_body, "h": hand}
    joined = reduce(lambda x, y: x.join(y, "frame_number", "full_outer"), [df.select("frame_number", F.col("kp").alias(n)) for n, df in names.items()])
    of = lambda name, n: F.coalesce(F.col(name), F.array_repeat(F.lit(None).cast(body.schema["kp"].dataType.elementType), n))
    rows = joined.select("frame_number", of("b", n_body).alias("b"), of("f", n_body + n_hand).alias("f"), of("h", n_hand).alias("h"))
    b, f = F.col("b"), F.col("f")
    roots = {n_body: 9, n_body + n_hand // 2: 10}
    by_root = lambda i, make, other: reduce(lambda out, r: F.when(i == r, make(roots[r])).otherwise(out), roots, other)
    own = F.transform(F.concat(F.slice(b, 1, n_body), F.slice("h", 1, n_hand)), lambda k, i: by_root(i, lambda w: b[w], k))
    rows = rows.select("frame_number", "f", own.alias("own"))
    merged = F.transform("own", lambda k, i: first_available([k, F.get(f, i), by_root(i, lambda w: f[w], F.lit(None))]))
    return rows.select("frame_number", merged.alias("kp"))


def windowed_median(df: DataFrame, value: str, before: int, after: int, key: str = "clip_key", order: str = "frame_index") -> Column:
    """Median of the present values among rows from ``before`` rows back to ``after`` ahead; NULL where the centre is missing."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-before, after)
    return F.when(F.col(value).isNotNull(), F.percentile(F.col(value), F.lit(0.5)).over(w))


def smooth(df: DataFrame, value: str, size: int, centred: bool, **by: str) -> Column:
    """Rolling median of ``size`` rows; centred windows are odd, others reach one row further back."""
    if size < 1 or (centred and size % 2 == 0):
        raise ValueError(f"window of {size} rows")
    return windowed_median(df, value, size // 2, size - size // 2 - 1, **by)


def fill_gaps(df: DataFrame, value: str, flagged: str, key: str = "clip_key", order: str = "frame_index") -> Column:
    """Flagged samples between two good ones by linear interpolation over rows; flagged ones elsewhere
    become NULL; what is not flagged stays as it is."""
    good = F.when(F.col(value).isNotNull() & ~F.col(flagged), F.struct(F.col(order).alias("i"), F.col(value).alias("v")))
    w = Window.partitionBy(key).orderBy(order)
    a = F.last(good, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    b = F.first(good, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    line = a["v"] + (b["v"] - a["v"]) * (F.col(order) - a["i"]) / (b["i"] - a["i"])
    return F.when(F.col(flagged), line).otherwise(F.col(value))


def midpoint_rows(df: DataFrame, n: int = 10, key: str = "clip_key", order: str = "frame_index") -> DataFrame:
    """The ``n`` middle rows of each clip that has as many; ``is_middle`` marks the one at n // 2."""
    total = F.count("*").over(Window.partitionBy(key))
    at = F.col(order) - F.floor((F.col("_n") - n) / 2)
    return df.withColumn("_n", total).filter((F.col("_n") >= n) & (at >= 0) & (at < n)).withColumn("is_middle", at == n // 2).drop("_n")


def flatten_persons(frames: DataFrame) -> DataFrame:
    """One row for each person of a frame, coordinates rounded to 2 and scores to 3 places, half to even.
    ``persons`` is an array of keypoint arrays [x, y, ..., score]."""
    person = frames.select("frame", F.posexplode("persons").alias("person_id", "kp"))
    rounded = F.transform("kp", lambda k: F.transform(k, lambda v, i: F.when(i == F.size(k) - 1, F.bround(v, 3)).otherwise(F.bround(v, 2))))
    return person.select("frame", "person_id", rounded.alias("kp"))


def whole_body_to_joints(points: Column) -> Column:
    """The joints of a whole-body detection of 133 points: the body, and both hands."""
    return F.concat(F.slice(points, 1, 17), F.slice(points, 92, 42))


def place_hands(labels: Column, hands: Column, n_hand: int = 21) -> Column:
    """Detected hands in their slots, left before right; a hand that was not detected is missing. A label that occurs
    twice takes its last hand."""
    def slot(label: str) -> Column:
        at = F.size(labels) - F.array_position(F.reverse(labels), label)
        found = F.when(F.array_contains(labels, label), F.get(hands, at.cast("int")))
        return F.transform(F.sequence(F.lit(0), F.lit(n_hand - 1)), lambda i: F.get(found, i))

    return F.concat(slot("left"), slot("right"))


def frame_range(frames: DataFrame, start: int = 0, end: int = -1, stride: int = 1, number: str = "frame_number") -> DataFrame:
    """Every ``stride``-th frame from ``start`` to before ``end`` (-1: to the last)."""
    n = F.col(number)
    return frames.filter((n >= start) & (F.lit(end == -1) | (n < end)) & ((n - start) % stride == 0))


def visible_joints(frames: DataFrame, hidden: list[int], dims: int = 3, floor: float = 0.05) -> DataFrame:
    """Rows (clip_key, frame_number, joint, coordinates, lik) of joints that are there, confident and not hidden."""
    axes = AXES[:dims]
    long = frames.select("clip_key", "frame_number", F.posexplode("kp").alias("joint", "k")).select("clip_key", "frame_number", "joint", *[F.col(f"k.{a}") for a in axes], "k.lik")
    there = reduce(lambda a, b: a & b, [finite(F.col(a)).isNotNull() for a in axes])
    return long.filter(there & (F.col("lik") >= floor) & ~F.col("joint").isin(hidden))


def extents(points: DataFrame, axes: str, key: str = "clip_key") -> DataFrame:
    """Plot ranges of each group: in 2D the bounds, widened by 13 % of the larger span; in 3D a cube of 1.18 times half
    the largest span, 1e-3 at least, about the middle."""
    found = points.groupBy(key).agg(*[f(a).alias(f"{a}_{f.__name__}") for a in axes for f in (F.min, F.max)])
    span = F.greatest(*[F.col(f"{a}_max") - F.col(f"{a}_min") for a in axes])
    if len(axes) == 2:
        return found.select(key, *[c for a in axes for c in ((F.col(f"{a}_min") - span * 0.13).alias(f"{a}_low"), (F.col(f"{a}_max") + span * 0.13).alias(f"{a}_high"))])
    half = F.greatest(span / 2, F.lit(1e-3)) * 1.18
    middle = {a: (F.col(f"{a}_min") + F.col(f"{a}_max")) / 2 for a in axes}
    return found.select(key, *[c for a in axes for c in ((middle[a] - half).alias(f"{a}_low"), (middle[a] + half).alias(f"{a}_high"))])


def trail_alpha(age: Column, n: Column) -> Column:
    """How opaque the pose of an ``age`` (0 the oldest) among ``n`` is drawn."""
    return F.when(n == 1, 1.0).otherwise(0.10 + 0.90 * F.pow(F.try_divide(age.cast("double"), n - 1), F.lit(1.7)))


def companion_pixels(frames: DataFrame, companion: DataFrame) -> DataFrame:
    """3D frames with the 2D keypoints of the same clip and place as ``kp_2d``; a clip whose companion has another number
    of frames has none."""
    n = lambda df, name: df.groupBy("clip_key").agg(F.count("*").alias(name))
    good = n(frames, "_a").join(n(companion, "_b"), "clip_key").filter("_a = _b").select("clip_key")
    pixels = companion.join(good, "clip_key", "left_semi").select("clip_key", "frame_index", F.col("kp").alias("kp_2d"))
    return frames.join(pixels, ["clip_key", "frame_index"], "left")


def frame_mismatches(a: DataFrame, b: DataFrame) -> DataFrame:
    """(clip_key, frame_number) that only one of two tables has."""
    keys = ["clip_key", "frame_number"]
    one, two = a.select(*keys), b.select(*keys)
    return one.join(two, keys, "left_anti").union(two.join(one, keys, "left_anti"))
