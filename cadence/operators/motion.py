"""Motion of a held subject: option grammars, pose over time, pulses, lens geometry, stabilising corrections. Column expressions only."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions.scalars import ease
from cadence.operators.trajectory import centred_zoom, invert

#: Bounds of keyframe columns, how near two of them may be, seconds of a bob, pixels around a lens, least scale of a subject.
POSE_RANGES = {"progress": (0.0, 1.0), "x": (-100.0, 100.0), "y": (-100.0, 100.0), "rotation": (-180.0, 180.0), "scale": (-75.0, 300.0)}
NEAR, BOB, AROUND, LEAST = 1e-6, 2.0, 4, 0.25


def numbers(text: Column, mark: str, count: int, low: float, high: float, kind: str = "double") -> Column:
    """``a,b`` or ``a-b-c`` as an array of numbers; null unless there are as many as asked, all numbers and in range."""
    # a sign belongs to a number, a mark stands between two
    parts = F.transform(F.split(text, mark), lambda p: F.trim(p).try_cast(kind))
    good = (F.size(parts) == count) & F.forall(parts, lambda v: v.isNotNull() & v.between(low, high))
    return F.when(good, parts)


def parse_move(text: Column) -> Column:
    """``dx,dy`` in percent of the frame, each within 100."""
    return numbers(text, ",", 2, -100, 100)


def parse_shift(text: Column) -> Column:
    """``dx,dy`` in percent, each within 90; null is a quarter to the left."""
    return numbers(F.coalesce(text, F.lit("-25,0")), ",", 2, -90, 90)


def parse_pattern(text: Column) -> Column:
    """``W-G-W``: whole frames of white, gap and white, 1 to 120 each; null is 2-2-2."""
    return numbers(F.coalesce(text, F.lit("2-2-2")), "-", 3, 1, 120, "int")


def keyframe_errors(poses: Column, most: int = 64) -> Column:
    """What is wrong with an array of poses in order of progress (texts, none if it is fine)."""
    names = list(POSE_RANGES)
    first = F.try_element_at(poses, F.lit(1))

    def outside(name: str) -> Column:
        return F.exists(poses, lambda p: ~F.coalesce(p[name].between(*POSE_RANGES[name]) & ~F.isnan(p[name]), F.lit(False)))

    bad = [(f"{n} out of range", outside(n)) for n in names]
    close = F.exists(F.sequence(F.lit(1), F.size(poses) - 1), lambda k: F.element_at(poses, k + 1)["progress"] - F.element_at(poses, k)["progress"] <= NEAR)
    rules = [
        ("none", F.size(poses) == 0), ("too many", F.size(poses) > most), *bad, ("same progress twice", F.when(F.size(poses) > 1, close)), ("does not begin at 0", F.abs(first["progress"]) > NEAR),
        ("begins in another pose", F.greatest(*[F.abs(first[n]) for n in names[1:]]) > NEAR),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules]))


def levitation(t: Column, at: float, dur: float, lift: float = 0.0, move: tuple[float, float] = (0.0, 0.0), rotate: float = 0.0, scale: float = 0.0, bob: float = 0.0, sway: float = 0.0, sway_period: float = 4.0, motion: str = "float", curve: float = 50.0, easing: str = "smooth", pose: Column | None = None, frame: tuple[float, float] | None = None) -> Column:
    """(dx, dy, rotation, scale) at time t: nothing until ``at``, then eased to the end pose over dur, then a bob (float, drift) and a sway (drift).

    With a pose (percent of the frame, as keyframes give it at the eased progress) that takes the place of lift, move, turn and scale.
    """
    since = t - at
    p = ease(F.least(F.greatest(since / max(dur, 1e-6), F.lit(0.0)), F.lit(1.0)), curve, easing)
    wave = lambda size, period: F.when(since > dur, size * F.sin(2 * pi * (since - dur) / max(period, 1e-6))).otherwise(0.0)
    if pose is None:
        dx, dy, turn, size = p * move[0], p * (move[1] - lift), p * rotate, p * scale
    else:
        if frame is None:
            raise ValueError("a pose needs the frame's size")
        dx, dy, turn, size = pose["x"] / 100 * frame[0], pose["y"] / 100 * frame[1], pose["rotation"], pose["scale"]
    if motion != "static" and bob > 0:
        dy = dy + wave(bob, BOB)
    if motion == "drift" and sway > 0:
        dx = dx + wave(sway, sway_period)
    out = {"dx": (dx, 0.0), "dy": (dy, 0.0), "rotation": (turn, 0.0), "scale": (F.greatest(F.lit(LEAST), 1 + size / 100), 1.0)}
    return F.struct(*[F.when(since > 0, v).otherwise(rest).cast("double").alias(name) for name, (v, rest) in out.items()])


def pulses(t: Column, moments: Column, pct: float, rise: float, hold: float, fall: float, curve: float = 50.0, easing: str = "smooth") -> Column:
    """Scale at time t under a pulse at each moment: one plus the pulses, which are added up."""
    clamp = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))

    def one(m: Column) -> Column:
        d = t - m
        return F.when((d < 0) | (d > rise + hold + fall), 0.0).otherwise(ease(clamp(d / max(rise, 1e-6)), curve, easing) * ease(clamp((rise + hold + fall - d) / max(fall, 1e-6)), curve, easing))

    return 1 + pct / 100 * F.aggregate(moments, F.lit(0.0), lambda s, m: s + one(m))


def moments_kept(moments: DataFrame, at: str, start: Column, duration: Column) -> DataFrame:
    """Moments on a segment's own clock; those more than half a second outside go."""
    return moments.withColumn(at, F.col(at) - start).filter(F.col(at).between(-0.5, duration + 0.5))


def even(v: Column) -> Column:
    return (F.floor(v / 2) * 2).cast("int")


def lens(width: Column, height: Column, size: Column, zoom: Column, feather: Column, ring: Column) -> Column:
    """Pixels of a round lens: radius, window (even, around the disc and its feather), the side of what it shows, the zoom that rounding leaves,
    feather and ring; ``fits`` tells whether the window is smaller than the frame."""
    small = F.least(width, height)
    radius = F.greatest(F.rint(size * small).cast("int"), F.lit(4))
    window = F.greatest(even((2 * radius + 2 * feather * radius + AROUND).cast("int")), 2 * radius)
    crop = F.greatest(even((2.0 * radius / zoom).cast("int")), F.lit(4))
    return F.struct(radius.alias("radius"), window.alias("win"), crop.alias("crop"), (2.0 * radius / crop).alias("zoom_eff"), (feather * radius).alias("feather_px"), F.greatest(F.lit(1.0), ring * radius).alias("ring_px"), (window < small).alias("fits"))


def corrections(path: DataFrame, keys: list[str], wanted: dict[str, str], width: float, height: float, most: float) -> DataFrame:
    """Similarities (a, b, tx, ty) that carry each frame of a path to where it is wanted, with the one centred zoom of a clip that hides its edges.

    ``wanted`` names the columns of the smoothed path; the correction is its inverse after the frame's own. The zoom covers how far the frame's
    centre moves, at most ``most``.
    """
    w = invert(F.col(wanted["a"]), F.col(wanted["b"]), F.col(wanted["tx"]), F.col(wanted["ty"]))
    held = path.withColumn("__w", w)
    a, b = (F.col("__w.a") * F.col("a") - F.col("__w.b") * F.col("b")), (F.col("__w.a") * F.col("b") + F.col("__w.b") * F.col("a"))
    x = F.col("__w.a") * F.col("tx") - F.col("__w.b") * F.col("ty") + F.col("__w.tx")
    y = F.col("__w.b") * F.col("tx") + F.col("__w.a") * F.col("ty") + F.col("__w.ty")
    held = held.withColumns({"ca": a, "cb": b, "cx": x, "cy": y})
    cx, cy = width / 2, height / 2
    far = F.greatest(F.abs(F.col("ca") * cx - F.col("cb") * cy + F.col("cx") - cx), F.abs(F.col("cb") * cx + F.col("ca") * cy + F.col("cy") - cy))
    zoom = centred_zoom(F.max(far).over(Window.partitionBy(*keys)), min(width, height), most)
    return held.withColumn("zoom", zoom).drop("__w")


def similarity_fit(points: DataFrame, keys: list[str], rounds: int = 3, outlier: float = 3.0, least: int = 6, scale: tuple[float, float] = (0.5, 2.0)) -> DataFrame:
    """(keys, a, b, tx, ty, inliers, points): the similarity that carries each group's points (x, y) to where they are next (u, v).

    Least squares by sums: sums of products about the means give factor and turn, the means the shift. Each round leaves out points that lie
    farther from where the fit puts them than ``outlier`` times their median distance, and fits the rest. A group with fewer points left
    than least, or a fit whose scale is out of bounds, has null for the similarity. Points without all four numbers are left out.
    """
    held = points.filter("x + y + u + v is not null").withColumn("__in", F.lit(True))

    def fit(rows: DataFrame) -> DataFrame:
        n, total = F.count_if("__in"), lambda v: F.sum(F.when(F.col("__in"), v).otherwise(0.0))
        x, y, u, v = (F.col(c) for c in "xyuv")
        sums = rows.groupBy(*keys).agg(n.alias("inliers"), F.count("*").alias("points"), *[total(c).alias(f"s_{k}") for k, c in zip("xyuv", (x, y, u, v))], total(x * x + y * y).alias("s_q"), total(x * u + y * v).alias("s_c"), total(x * v - y * u).alias("s_s"))
        mean = {k: F.col(f"s_{k}") / F.nullif("inliers", F.lit(0)) for k in "xyuv"}
        size = F.col("s_q") - F.col("inliers") * (mean["x"] * mean["x"] + mean["y"] * mean["y"])
        a = F.try_divide(F.col("s_c") - F.col("inliers") * (mean["x"] * mean["u"] + mean["y"] * mean["v"]), size)
        b = F.try_divide(F.col("s_s") - F.col("inliers") * (mean["x"] * mean["v"] - mean["y"] * mean["u"]), size)
        return sums.withColumns({"a": a, "b": b, "__mx": mean["x"], "__my": mean["y"], "__mu": mean["u"], "__mv": mean["v"]}).select(*keys, "inliers", "points", "a", "b", (F.col("__mu") - F.col("a") * F.col("__mx") + F.col("b") * F.col("__my")).alias("tx"), (F.col("__mv") - F.col("b") * F.col("__mx") - F.col("a") * F.col("__my")).alias("ty"))

    for _ in range(rounds):
        met = held.join(fit(held).drop("inliers", "points"), keys)
        far = F.hypot(F.col("a") * F.col("x") - F.col("b") * F.col("y") + F.col("tx") - F.col("u"), F.col("b") * F.col("x") + F.col("a") * F.col("y") + F.col("ty") - F.col("v"))
        met = met.withColumn("__far", far)
        limits = met.groupBy(*keys).agg(F.percentile("__far", 0.5).alias("__m"))
        held = met.join(limits, keys).withColumn("__in", F.coalesce(F.col("__far") <= outlier * F.col("__m") + 1e-9, F.lit(False))).select(*keys, "x", "y", "u", "v", "__in")
    out = fit(held)
    good = (F.col("inliers") >= least) & F.hypot("a", "b").between(*scale)
    return out.select(*keys, *[F.when(good, F.col(c)).alias(c) for c in ("a", "b", "tx", "ty")], "inliers", "points")


def trajectory(fits: DataFrame, keys: list[str], at: str, every: int = 30, carries: int = 2) -> DataFrame:
    """Fits in order with what stands in for those that failed: the last that did not (none before the first: no motion), ``carried`` since how
    many frames, and ``detect``: whether points should be found anew, each ``every`` frames or after so many carried ones."""
    order = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(at))
    held = fits.withColumn("__n", place).withColumn("__last", F.last(F.when(F.col("a").isNotNull(), F.struct("a", "b", "tx", "ty", "__n")), True).over(order))
    rest = {"a": 1.0, "b": 0.0, "tx": 0.0, "ty": 0.0}
    carried = F.col("__n") - F.coalesce("__last.__n", F.lit(0))
    kept = [F.coalesce(F.col(f"__last.{c}"), F.lit(v)).alias(c) for c, v in rest.items()]
    return held.select(*keys, at, *kept, carried.cast("int").alias("carried"), (((F.col("__n") - 1) % every == 0) | ((carried > 0) & (carried % carries == 0))).alias("detect"))


def reduction(path: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """(keys, reduction): by how many percent the steps of a path are smaller after than before; null where it stood still."""
    size = lambda c: F.stddev_pop(c)
    return path.groupBy(*keys).agg(((1 - F.try_divide(size(after), size(before))) * 100).alias("reduction"))


def display_name(role: Column) -> Column:
    """A role as a title: words between spaces, hyphens and underscores, each with a capital."""
    return F.initcap(F.trim(F.regexp_replace(F.lower(role), "[\\s_-]+", " ")))


def session_name(prefix: str, role: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), role)


def escape_path(path: Column) -> Column:
    """A path inside a filter's quotes: forward slashes, colons and quotes marked."""
    p = F.replace(F.replace(path, F.lit("\\"), F.lit("/")), F.lit(":"), F.lit("\\:"))
    return F.concat(F.lit("'"), F.replace(p, F.lit("'"), F.lit("\\'")), F.lit("'"))


def archived(messages: DataFrame, taken: DataFrame, name: str = "name") -> DataFrame:
    """Names for an archive, in order of arrival (column ``at``): a name that is not taken yet stays, the others get a number above all that
    their name has, among the taken as among the arriving, and above how often it is taken: no two results are the same, and none is taken."""
    numbered = F.regexp_extract(name, "^(.*)[.]([0-9]{1,18})$", 1), F.regexp_extract(name, "^(.*)[.]([0-9]{1,18})$", 2).try_cast("long")
    every = taken.select(name).unionByName(messages.select(name)).select(numbered[0].alias("__n"), numbered[1].alias("__k"))
    most = every.filter("__k is not null").groupBy("__n").agg(F.max("__k").alias("__most"))
    have = taken.groupBy(F.col(name).alias("__t")).agg(F.count("*").alias("__have"))
    held = messages.join(have, F.col(name) == F.col("__t"), "left").join(most, F.col(name) == F.col("__n"), "left")
    place = F.row_number().over(Window.partitionBy(name).orderBy("at")) - F.when(F.col("__t").isNull(), 1).otherwise(0)
    held = held.withColumn("__p", place)
    number = (F.greatest(F.coalesce("__most", F.lit(0)), F.coalesce(F.col("__have") - 1, F.lit(0))) + F.col("__p")).cast("string")
    return held.select(*messages.columns, F.when(F.col("__p") == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit("."), number)).alias("archived"))
