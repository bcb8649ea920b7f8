"""Queries of motion: grammars, poses, pulses, lenses, corrections, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadence.operators import motion as M
from cadence.operators import trajectory as T
from cadence.session import table

r6 = lambda c: F.round(c, 6)


def move_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 240 - 120).alias("n"), "p_size")
    text = F.concat(F.col("n").cast("string"), F.lit(", "), F.when(F.col("p_size") == 7, "x").otherwise(F.col("p_size").cast("string")))
    dashed = F.concat_ws("-", F.lit("2"), (F.col("n") + 10).cast("string"), F.col("p_size").cast("string"))
    show = lambda c: F.array_join(F.transform(c, lambda v: v.cast("int").cast("string")), " ")
    return p.select("p_partkey", show(M.parse_move(text)).alias("move"), show(M.parse_shift(F.when(F.col("p_size") != 9, text))).alias("shift"), show(M.parse_pattern(dashed)).alias("pattern"))


def keyframe_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = table(spark, sf_dir, "part"), F.col("p_partkey")
    pose = lambda at, x, turn: F.struct(at.cast("double").alias("progress"), x.cast("double").alias("x"), F.lit(0.0).alias("y"), turn.cast("double").alias("rotation"), F.lit(0.0).alias("scale"))
    second = pose((n % 3) / F.lit(2.0), n % 130, n % 200)
    track = F.when(n % 11 == 0, F.array().cast("array<struct<progress:double,x:double,y:double,rotation:double,scale:double>>")).otherwise(F.array(pose(F.lit(0.0), F.when(n % 7 == 0, 5.0).otherwise(0.0), F.lit(0.0)), second))
    return p.select("p_partkey", F.array_join(M.keyframe_errors(track), ";").alias("errors"))


def levitation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", M.levitation(F.col("event_id") % 100 / 10.0, 2.0, 1.5, 40.0, (12.0, 6.0), 30.0, 20.0, 5.0, 8.0, 3.0, "drift", easing="linear").alias("p"))
    return e.select("event_id", *[r6(f"p.{c}").alias(c) for c in ("dx", "dy", "rotation", "scale")])


def zoom_pulses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", r6(M.pulses(F.col("event_id") % 200 / 10.0, F.array(F.lit(2.0), F.lit(7.5), F.lit(15.0)), 25.0, 0.5, 1.0, 0.8, easing="linear")).alias("zoom"))


def moments_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("at"))
    return M.moments_kept(e, "at", F.lit(10.0), F.lit(30.0)).select("event_id", r6("at").alias("at"))


def lens_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = table(spark, sf_dir, "part"), F.col("p_size")
    g = M.lens(F.lit(1280), F.lit(720), n / 100.0, 1.25 + (F.col("p_partkey") % 8) / 4.0, (F.col("p_partkey") % 5) / 10.0, F.lit(0.05))
    return p.select("p_partkey", g.alias("g")).select("p_partkey", "g.radius", "g.win", "g.crop", r6("g.zoom_eff").alias("zoom_eff"), r6("g.feather_px").alias("feather_px"), r6("g.ring_px").alias("ring_px"), "g.fits")


def path_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.lit(1.0).alias("a"), ((F.col("event_id") % 5 - 2) / 100.0).alias("b"), (F.col("value") / 10).alias("tx"), (F.col("event_id") % 9 * 1.0).alias("ty"), F.lit(1.0).alias("sa"), F.lit(0.0).alias("sb"), F.lit(5.0).alias("sx"), F.lit(4.0).alias("sy"))
    c = M.corrections(e, ["user_id"], {"a": "sa", "b": "sb", "tx": "sx", "ty": "sy"}, 640.0, 360.0, 1.3)
    return c.select("event_id", *[r6(x).alias(x) for x in ("ca", "cb", "cx", "cy", "zoom")])


def role_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("_", F.lower("p_type"), F.lit("size-lead")).alias("role"))
    return p.select("p_partkey", M.display_name(F.col("role")).alias("shown"), M.session_name("run", F.col("role")).alias("session"), M.escape_path(F.concat(F.lit("C:\\"), F.col("role"), F.lit("'s"))).alias("path"))


def archive_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("name"), F.col("o_orderkey").alias("at"))
    taken = o.filter("at % 4 = 0").withColumn("name", F.when(F.col("at") % 8 == 0, F.concat("name", F.lit("."), (F.col("at") % 3 + 1).cast("string"))).otherwise(F.col("name")))
    return M.archived(o.filter("at % 4 > 0"), taken).select("at", "archived")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of each vector as points, carried on by a similarity of the vector's own; some points go elsewhere, and every ninth vector has few."""
    n = F.col("vec_id")
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding", (1 + (n % 7 - 3) / 100.0).alias("a"), ((n % 5 - 2) / 50.0).alias("b"), (n % 11 / 10.0).alias("tx"), (n % 13 / 10.0).alias("ty"))
    ks = F.sequence(F.lit(0), F.when(n % 9 == 0, 3).otherwise(31))
    p = e.withColumn("k", F.explode(ks)).withColumns({"x": F.element_at("embedding", F.col("k") * 2 + 1).cast("double"), "y": F.element_at("embedding", F.col("k") * 2 + 2).cast("double")})
    off, noise = F.when(F.col("k") % 8 == 3, 5.0 + F.col("k") / 10).otherwise(0.0), (F.col("k") % 3 - 1) / 1000.0
    return p.select("label", "vec_id", "x", "y", (F.col("a") * F.col("x") - F.col("b") * F.col("y") + F.col("tx") + off + noise).alias("u"), (F.col("b") * F.col("x") + F.col("a") * F.col("y") + F.col("ty") - off / 2).alias("v"))


def motion_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = M.similarity_fit(_points(spark, sf_dir), ["label", "vec_id"])
    return f.select("vec_id", *[F.round(c, 5).alias(c) for c in ("a", "b", "tx", "ty")], "inliers", "points")


def motion_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's motion, or the last that was found, and when points would be found anew."""
    t = M.trajectory(M.similarity_fit(_points(spark, sf_dir), ["label", "vec_id"]), ["label"], "vec_id", 10)
    return t.select("label", "vec_id", *[F.round(c, 5).alias(c) for c in ("a", "b", "tx", "ty")], "carried", "detect")


def shake_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much smaller a user's steps are after smoothing."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.avg("value").over(order.rowsBetween(-2, 2)).alias("smooth"))
    e = e.withColumns({"before": F.col("value") - F.lag("value").over(order), "after": F.col("smooth") - F.lag("smooth").over(order)})
    return M.reduction(e, ["user_id"], "before", "after").select("user_id", F.round("reduction", 5).alias("reduction"))


def track_lerp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's clicks on the track of their own purchases."""
    e = table(spark, sf_dir, "events")
    track = e.filter("event_type = 'purchase'").select("user_id", (F.col("event_id") % 97 / 96.0).alias("progress"), F.col("value").alias("x"), (F.col("event_id") % 50).cast("double").alias("y"))
    points = e.filter("event_type = 'click'").select("user_id", "event_id", (F.col("event_id") % 121 / 100.0 - 0.1).alias("p"))
    return T.interpolate_tracks(points, track, ["user_id"], "p", ["x", "y"]).select("event_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


QUERIES = {f.__name__: f for f in (move_grammar, keyframe_checks, levitation, zoom_pulses, moments_kept, lens_geometry, path_corrections, role_names, archive_names, motion_fit, motion_path, shake_reduction, track_lerp)}

def _fit_sql(rounds: int = 3) -> str:
    """The rounds one after another: sums, fit, distances, median."""
    out = """src as (select label, vec_id, unnest(range(case when vec_id % 9 = 0 then 4 else 32 end)) as k, embedding, 1 + (vec_id % 7 - 3) / 100.0::double as ga, (vec_id % 5 - 2) / 50.0::double as gb, vec_id % 11 / 10.0::double as gx, vec_id % 13 / 10.0::double as gy from embeddings),
xy as (select label, vec_id, k, embedding[k * 2 + 1]::double as x, embedding[k * 2 + 2]::double as y, ga, gb, gx, gy from src),
p0 as (select label, vec_id, x, y, ga * x - gb * y + gx + case when k % 8 = 3 then 5 + k / 10.0::double else 0 end + (k % 3 - 1) / 1000.0::double as u, gb * x + ga * y + gy - case when k % 8 = 3 then 5 + k / 10.0::double else 0 end / 2 as v, true as inl from xy)"""
    for k in range(rounds + 1):
        out += f""", m{k} as (select label, vec_id, count(*) as points, count(*) filter (where inl) as inliers, avg(x) filter (where inl) as mx, avg(y) filter (where inl) as my, avg(u) filter (where inl) as mu, avg(v) filter (where inl) as mv from p{k} group by 1, 2),
f{k} as (select m.label, m.vec_id, points, inliers, mx, my, mu, mv, sum((x - mx) * (u - mu) + (y - my) * (v - mv)) filter (where inl) / sum((x - mx) ** 2 + (y - my) ** 2) filter (where inl) as a, sum((x - mx) * (v - mv) - (y - my) * (u - mu)) filter (where inl) / sum((x - mx) ** 2 + (y - my) ** 2) filter (where inl) as b from p{k} p join m{k} m on p.label = m.label and p.vec_id = m.vec_id group by all),
g{k} as (select *, mu - a * mx + b * my as tx, mv - b * mx - a * my as ty from f{k})"""
        if k < rounds:
            out += f""", d{k} as (select p.label, p.vec_id, x, y, u, v, sqrt((a * x - b * y + tx - u) ** 2 + (b * x + a * y + ty - v) ** 2) as far from p{k} p join g{k} g on p.label = g.label and p.vec_id = g.vec_id),
p{k + 1} as (select label, vec_id, x, y, u, v, far <= 3 * median(far) over (partition by label, vec_id) + 1e-9 as inl from d{k})"""
    good = "inliers >= 6 and sqrt(a * a + b * b) between 0.5 and 2"
    return out + f", fit as (select label, vec_id, case when {good} then a end as a, case when {good} then b end as b, case when {good} then tx end as tx, case when {good} then ty end as ty, inliers, points from g{rounds})"


ORACLES = {
    "move_grammar": "with x as (select p_partkey, p_partkey % 240 - 120 as n, p_size as z from part) select p_partkey, case when abs(n) <= 100 and z <> 7 then n || ' ' || z end as move, case when z = 9 then '-25 0' when abs(n) <= 90 and z <> 7 then n || ' ' || z end as shift, case when n + 10 between 1 and 120 then '2 ' || (n + 10) || ' ' || z end as pattern from x",
    "keyframe_checks": "with x as (select p_partkey as n from part) select n as p_partkey, case when n % 11 = 0 then 'none' else concat_ws(';', case when n % 130 > 100 then 'x out of range' end, case when n % 200 > 180 then 'rotation out of range' end, case when n % 3 = 0 then 'same progress twice' end, case when n % 7 = 0 then 'begins in another pose' end) end as errors from x",
    "levitation": "with e as (select event_id, (event_id % 100) / 10.0::double - 2.0::double as d from events), p as (select *, least(greatest(d / 1.5::double, 0), 1) as p from e) select event_id, round(case when d > 0 then p * 12 + case when d > 1.5 then 8 * sin(2 * pi() * (d - 1.5::double) / 3) else 0 end else 0 end, 6) + 0.0::double as dx, round(case when d > 0 then p * (6 - 40) + case when d > 1.5 then 5 * sin(2 * pi() * (d - 1.5::double) / 2) else 0 end else 0 end, 6) + 0.0::double as dy, round(case when d > 0 then p * 30 else 0 end, 6)::double as rotation, round(case when d > 0 then 1 + p * 20 / 100 else 1 end, 6)::double as scale from p",
    "zoom_pulses": "with e as (select event_id, (event_id % 200) / 10.0::double as t from events), m(m) as (values (2.0::double), (7.5::double), (15.0::double)), d as (select event_id, t - m as d from e cross join m) select event_id, round(1 + 0.25::double * sum(case when d < 0 or d > 0.5::double + 1.0::double + 0.8::double then 0 else least(greatest(d / 0.5::double, 0), 1) * least(greatest((0.5::double + 1.0::double + 0.8::double - d) / 0.8::double, 0), 1) end), 6) as zoom from d group by 1",
    "moments_kept": "select event_id, round(value - 10.0::double, 6) as at from events where value - 10.0::double between -0.5 and 30.5",
    "lens_geometry": "with x as (select p_partkey, greatest(cast(round_even(p_size / 100.0::double * 720, 0) as int), 4) as r, 1.25::double + (p_partkey % 8) / 4.0::double as z, (p_partkey % 5) / 10.0::double as f from part), y as (select *, greatest(cast(floor(2 * r + 2 * f * r + 4) as int) // 2 * 2, 2 * r) as w, greatest(cast(floor(2.0::double * r / z) as int) // 2 * 2, 4) as c from x) select p_partkey, r as radius, w as win, c as crop, round(2.0::double * r / c, 6) as zoom_eff, round(f * r, 6) as feather_px, round(greatest(1.0::double, 0.05::double * r), 6) as ring_px, w < 720 as fits from y",
    "path_corrections": "with e as (select user_id, event_id, (event_id % 5 - 2) / 100.0::double as b, value / 10 - 5 as x, (event_id % 9)::double - 4 as y from events), f as (select *, greatest(abs(320 - b * 180 + x - 320), abs(b * 320 + 180 + y - 180)) as far from e), z as (select user_id, max(far) as far from f group by 1) select event_id, 1.0::double as ca, round(b, 6) + 0.0::double as cb, round(x, 6) + 0.0::double as cx, round(y, 6) + 0.0::double as cy, round(least(greatest(360 / greatest(360 - 2 * z.far, 1e-6), 1), 1.3::double), 6) as zoom from f join z using (user_id)",
    "role_names": "with x as (select p_partkey, lower(p_type) as t from part) select p_partkey, upper(substr(t, 1, 1)) || substr(t, 2) || ' Size Lead' as shown, 'run-' || t || '_size-lead' as session, '''C\\:/' || t || '_size-lead\\''s''' as path from x",
    "archive_names": "with o as (select o_custkey::varchar as name, o_orderkey as stored from orders), h as (select name, count(*) filter (where stored % 8 > 0) as have, greatest(coalesce(max(stored % 3 + 1) filter (where stored % 8 = 0), 0), count(*) filter (where stored % 8 > 0) - 1) as most from o where stored % 4 = 0 group by 1), k as (select o.name, stored, row_number() over (partition by o.name order by stored) - case when coalesce(have, 0) > 0 then 0 else 1 end as k, coalesce(most, 0) as most from o left join h using (name) where stored % 4 > 0) select stored as at, case when k = 0 then name else name || '.' || (k + most) end as archived from k",
    "motion_fit": f"with {_fit_sql()} select vec_id, round(a, 5) as a, round(b, 5) as b, round(tx, 5) as tx, round(ty, 5) as ty, inliers, points from fit",
    "motion_path": f"""with {_fit_sql()}, o as (select *, row_number() over (partition by label order by vec_id) as n from fit), l as (select *, max(case when a is not null then n end) over (partition by label order by vec_id rows unbounded preceding) as last from o)
select l.label, l.vec_id, round(coalesce(p.a, 1), 5) as a, round(coalesce(p.b, 0), 5) as b, round(coalesce(p.tx, 0), 5) as tx, round(coalesce(p.ty, 0), 5) as ty, cast(l.n - coalesce(l.last, 0) as int) as carried, (l.n - 1) % 10 = 0 or (l.n > coalesce(l.last, 0) and (l.n - coalesce(l.last, 0)) % 2 = 0) as detect from l left join o p on p.label = l.label and p.n = l.last""",
    "shake_reduction": "with s as (select user_id, event_id, value, avg(value) over (partition by user_id order by event_id rows between 2 preceding and 2 following) as smooth from events), d as (select user_id, value - lag(value) over w as b, smooth - lag(smooth) over w as a from s window w as (partition by user_id order by event_id)) select user_id, round((1 - stddev_pop(a) / nullif(stddev_pop(b), 0)) * 100, 5) as reduction from d group by 1",
    "track_lerp": """with k as (select user_id, event_id % 97 / 96.0::double as p, value as x, (event_id % 50)::double as y from events where event_type = 'purchase'), q as (select user_id, event_id, least(greatest(event_id % 121 / 100.0::double - 0.1, 0), 1) as p from events where event_type = 'click'),
f as (select q.user_id, q.event_id, q.p, max(case when k.p < q.p then {'p': k.p, 'x': k.x, 'y': k.y} end) as a, min(case when k.p >= q.p then {'p': k.p, 'x': k.x, 'y': k.y} end) as b from q join k using (user_id) group by 1, 2, 3)
select event_id, round(case when b.p = p then b.x else a.x + (b.x - a.x) * (p - a.p) / (b.p - a.p) end, 6) as x, round(case when b.p = p then b.y else a.y + (b.y - a.y) * (p - a.p) / (b.p - a.p) end, 6) as y from f where b is not null and (a is not null or b.p = p)""",
}
