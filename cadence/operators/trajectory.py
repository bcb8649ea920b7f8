"""Trajectories and curves: keyframes, schedules, zoom, accumulated and smoothed paths, similarity transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions.scalars import ease

POSE = ["x", "y", "rotation", "scale"]
#: Keyframes of a track at most.
MOST = 10_000


def interpolate(points: DataFrame, keyframes: DataFrame, progress: str, columns: list[str] = POSE) -> DataFrame:
    """Linear interpolation of keyframe columns at each point's progress, clamped to 0..1.

    Keyframes (column ``progress``; more than MOST fail) are held in order as arrays, where a point finds its segment by halving:
    the work of a point grows with the logarithm of the track. Points before the first or after the last keyframe give no row.
    """
    held = keyframes.select("progress", *columns).orderBy("progress").limit(MOST + 1).collect()
    if len(held) > MOST:
        raise ValueError(f"a track has at most {MOST} keyframes")
    starts = [float(r["progress"]) for r in held]
    p = F.least(F.greatest(F.col(progress), F.lit(0.0)), F.lit(1.0))
    steps = [1 << k for k in range(len(starts).bit_length() - 1, -1, -1)]
    at = lambda values, n: F.element_at(F.lit(values), F.greatest(F.least(n, F.lit(len(starts))), F.lit(1)))
    below = F.aggregate(F.lit(steps), F.lit(0), lambda n, step: F.when((n + step <= len(starts)) & (at(starts, n + step) < F.col("__p")), n + step).otherwise(n))
    met = points.withColumn("__p", p).withColumn("__k", below if len(starts) > 1 else F.lit(0))
    met = met.withColumn("__k", F.when((F.col("__p") <= 0) & F.lit(bool(starts) and starts[0] <= 0), F.greatest("__k", F.lit(1))).otherwise(F.col("__k"))).filter((F.col("__k") >= 1) & (F.col("__k") < len(starts)))
    parts = {"__a": starts} | {f"__{c}": [float(r[c]) for r in held] for c in columns}
    for name, values in parts.items():
        first, second = (name, "__b") if name == "__a" else (f"{name}0", f"{name}1")
        met = met.withColumns({first: at(values, F.col("__k")), second: at(values, F.col("__k") + 1)}) if len(starts) > 1 else met.withColumns({first: F.lit(None).cast("double"), second: F.lit(None).cast("double")})
    # two keyframes at one progress: a point just there is at the first
    share = F.coalesce(F.try_divide(F.col("__p") - F.col("__a"), F.col("__b") - F.col("__a")), F.lit(0.0))
    return met.select(*points.columns, *[(F.col(f"__{c}0") + (F.col(f"__{c}1") - F.col(f"__{c}0")) * share).alias(c) for c in columns])


def interpolate_tracks(points: DataFrame, keyframes: DataFrame, keys: list[str], progress: str, columns: list[str] = POSE) -> DataFrame:
    """Linear interpolation on a track for each key: points with the keyframes (keys, ``progress``, columns) of their own key.

    Points and keyframes are sorted into one line of each key, where a point sees the last keyframe before it and the first from it on; no
    track is gathered. Progress is clamped to 0..1. Of several keyframes at one progress a point just there is at the first (by the columns),
    points after it begin from the last. Points before a track's first keyframe, after its last, or without a track give no row.
    """
    own = F.struct(F.col("progress").cast("double").alias("p"), *[F.col(c).cast("double").alias(c) for c in columns])
    row = F.struct(*[F.col(c) for c in points.columns])
    kind = points.select(row.alias("r")).schema["r"].dataType
    frames = keyframes.select(*keys, F.col("progress").cast("double").alias("__t"), own.alias("__key"), F.lit(None).cast(kind).alias("__row"))
    at = F.least(F.greatest(F.col(progress).cast("double"), F.lit(0.0)), F.lit(1.0))
    line = frames.unionByName(points.select(*keys, at.alias("__t"), F.lit(None).cast(frames.schema["__key"].dataType).alias("__key"), row.alias("__row")))
    order = Window.partitionBy(*keys).orderBy("__t", F.col("__key").isNotNull(), "__key")
    met = line.withColumns({
        "__a": F.last("__key", True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "__b": F.first("__key", True).over(order.rowsBetween(0, Window.unboundedFollowing)),
    }).filter("__row is not null and __b is not null and (__a is not null or __b.p = __t)")
    share = F.coalesce(F.try_divide(F.col("__t") - F.col("__a.p"), F.col("__b.p") - F.col("__a.p")), F.lit(1.0))
    # a point at a keyframe is there, whatever the rounding
    value = lambda c: F.when((F.col("__b.p") == F.col("__t")) | F.col("__a").isNull(), F.col(f"__b.{c}")).otherwise(F.col(f"__a.{c}") + (F.col(f"__b.{c}") - F.col(f"__a.{c}")) * share)
    return met.select("__row.*", *[value(c).alias(c) for c in columns])


def parse_keyframes(text: Column) -> Column:
    """``P:X,Y[,ROT[,SCALE]];...`` (= for : too) as an array of poses in order of progress; what is not given is no rotation, scale 100."""
    items = F.filter(F.transform(F.split(text, ";"), lambda s: F.trim(s)), lambda s: s != "")
    number = lambda parts, i, other: F.coalesce(F.try_element_at(parts, F.lit(i)).try_cast("double"), F.lit(other))

    def pose(s: Column) -> Column:
        head, tail = F.split(F.replace(s, F.lit("="), F.lit(":")), ":")[0], F.split(F.try_element_at(F.split(F.replace(s, F.lit("="), F.lit(":")), ":"), F.lit(2)), ",")
        return F.struct(head.try_cast("double").alias("progress"), number(tail, 1, 0.0).alias("x"), number(tail, 2, 0.0).alias("y"), number(tail, 3, 0.0).alias("rotation"), number(tail, 4, 100.0).alias("scale"))

    return F.array_sort(F.transform(items, pose))


def phase(frame: Column, at: Column, total: Column, white: int, gap: int, white2: int, vanish: bool = False) -> Column:
    """Phase of a frame from its place after ``at`` (kept within 1..total - 1); before it there is none."""
    f0 = F.least(F.greatest(at, F.lit(1)), F.greatest(total - 1, F.lit(1)))
    half = gap if vanish else max(gap // 2, 1)
    d = frame - f0
    late = "empty" if vanish else None
    return F.when(d < 0, None).when(d < white, "white_a").when(d < white + half, "empty").when(d < white + gap, late or "appear").when(d < white + gap + white2, late or "white_b").otherwise(late or "after")


def zoom(t: Column, duration: Column, pct: float = 20.0, direction: str = "grow", hold: float = 0.4, curve: float = 50.0, easing: str = "smooth") -> Column:
    """Scale at time t: one plus or minus pct eased in and out; ``pulse`` holds its peak."""
    dur = F.greatest(duration, F.lit(0.001))
    if direction == "pulse":
        rise = max((1 - hold) / 2, 0.05)
        parts = dur * rise, dur * hold, dur * max(1 - rise - hold, 0.001)
    else:
        parts = dur, F.lit(0.0), F.lit(0.001)
    clamp = lambda p: F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
    into, back = ease(clamp(t / parts[0]), curve, easing), ease(clamp((parts[0] + parts[1] + parts[2] - t) / parts[2]), curve, easing)
    return 1 + (-1 if direction == "shrink" else 1) * (pct / 100) * into * back


def accumulate(rows: DataFrame, keys: list[str], at: str, moves: list[str]) -> DataFrame:
    """Running sums of moves: the path of pure translation."""
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({f"path_{m}": F.sum(m).over(w) for m in moves})


def shake(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median and population deviation of motion; zero for fewer than two rows."""
    few = F.count(value) < 2
    return rows.groupBy(*keys).agg(F.when(few, 0.0).otherwise(F.median(value)).alias("median"), F.when(few, 0.0).otherwise(F.stddev_pop(value)).alias("deviation"))


def residual(rows: DataFrame, keys: list[str], at: str, value: str, scale: float = 1.0) -> DataFrame:
    """Shake of first differences, scaled."""
    step = rows.withColumn("__d", (F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(at))) * scale)
    return shake(step.filter("__d is not null"), keys, "__d")


def smooth(rows: DataFrame, keys: list[str], place: str, value: str, sigma: float) -> DataFrame:
    """Gaussian smoothing over dense places (0, 1, 2 ... of a key), cut at four sigma, ends repeated.

    Neighbours come by lag and lead of one window: the rows are shuffled and sorted once.
    """
    reach = int(4 * sigma + 0.5)
    weights = [2.718281828459045 ** (-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    total = sum(weights)
    order = Window.partitionBy(*keys).orderBy(place)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = {f"__{k + reach}": F.lead(value, k).over(order) if k > 0 else F.lag(value, -k).over(order) if k < 0 else F.col(value) for k in range(-reach, reach + 1)}
    held = rows.select(*keys, place, value, F.first(value).over(whole).alias("__first"), F.last(value).over(whole).alias("__end"), F.max(place).over(whole).alias("__last")).withColumns(near)
    taken = lambda k: F.when(F.col(place) + k < 0, F.col("__first")).when(F.col(place) + k > F.col("__last"), F.col("__end")).otherwise(F.col(f"__{k + reach}"))
    smoothed = sum((taken(k) * F.lit(w / total) for k, w in zip(range(-reach, reach + 1), weights)), F.lit(0.0))
    return held.select(*keys, place, smoothed.alias("smooth"))


def zip_places(left: DataFrame, right: DataFrame, keys: list[str], order_left: str, order_right: str) -> DataFrame:
    """Rows of both sides by their ordinal within the key, as far as the shorter goes."""
    a = left.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(order_left)))
    b = right.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(order_right)))
    return a.join(b, [*keys, "place"])


def carry(rows: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """The last value that is not null so far."""
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w))


def decompose(a: Column, b: Column, tx: Column, ty: Column) -> Column:
    """Scale, degrees and shift of the similarity [[a, -b, tx], [b, a, ty]]."""
    return F.struct(F.hypot(a, b).alias("scale"), F.degrees(F.atan2(b, a)).alias("angle"), tx.alias("tx"), ty.alias("ty"))


def invert(a: Column, b: Column, tx: Column, ty: Column) -> Column:
    """The inverse similarity; a singular one fails."""
    det = a * a + b * b
    ok = F.when(det < 1e-9, F.raise_error(F.lit("singular transform"))).otherwise(det)
    return F.struct((a / ok).alias("a"), (-b / ok).alias("b"), (-(a * tx + b * ty) / ok).alias("tx"), ((b * tx - a * ty) / ok).alias("ty"))


def centred_zoom(excursion: Column, side: float, most: float) -> Column:
    """Zoom that hides an excursion from the frame, within 1..most."""
    return F.least(F.greatest(side / F.greatest(side - 2 * excursion, F.lit(1e-6)), F.lit(1.0)), F.lit(most))


def lift(t: Column, at: float, height: float, dur: float, bob: float, period: float = 2.0) -> Column:
    """Vertical offset: eased rise after ``at``, then a sine; nothing before."""
    rise = ease((t - at) / dur) * height
    wave = F.when(t > at + dur, bob * F.sin(2 * 3.141592653589793 * (t - at - dur) / period)).otherwise(0.0)
    return F.when(t <= at, 0.0).otherwise(rise + wave)


def envelope(t: Column, start: float, end: float, fade: float, curve: float = 50.0, easing: str = "smooth") -> Column:
    """Wetness of a region: eased ramps at both ends, zero outside."""
    ramp = F.least(ease((t - start) / fade, curve, easing), ease((end - t) / fade, curve, easing))
    return F.when((t < start) | (t > end), 0.0).otherwise(ramp)


def accumulate_similarity(rows: DataFrame, keys: list[str], at: str, a: str = "a", b: str = "b", tx: str = "tx", ty: str = "ty") -> DataFrame:
    """Running product of the inverses of similarity transforms, as pa, pb, px, py.

    A similarity is a complex factor and a shift. Factors multiply by adding logarithms and angles, and a shift is
    turned by the factors before it, so the ordered product is three running sums.
    """
    order = Window.partitionBy(*keys).orderBy(at)
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    n = rows.withColumn("__n", invert(F.col(a), F.col(b), F.col(tx), F.col(ty)))
    log, turn = F.log(F.hypot("__n.a", "__n.b")), F.atan2("__n.b", "__n.a")
    size = lambda w: F.exp(F.coalesce(F.sum(log).over(w), F.lit(0.0)))
    angle = lambda w: F.coalesce(F.sum(turn).over(w), F.lit(0.0))
    n = n.withColumns({"pa": size(upto) * F.cos(angle(upto)), "pb": size(upto) * F.sin(angle(upto)), "__c": size(before) * F.cos(angle(before)), "__s": size(before) * F.sin(angle(before))})
    x, y = F.col("__n.tx"), F.col("__n.ty")
    n = n.withColumns({"__x": F.col("__c") * x - F.col("__s") * y, "__y": F.col("__s") * x + F.col("__c") * y})
    return n.withColumns({"px": F.sum("__x").over(upto), "py": F.sum("__y").over(upto)}).drop("__n", "__c", "__s", "__x", "__y")


def riser(n: int, length: float, shrink: float = 0.72) -> list[tuple[float, float]]:
    """(start, duration) of notes that get shorter by a fixed factor and fill the length."""
    share = [shrink**i for i in range(n)]
    out, at = [], 0.0
    for w in share:
        out.append((at, length * w / sum(share)))
        at += out[-1][1]
    return out
