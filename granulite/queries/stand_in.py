"""The shared tables read as frames, scans, positions and events; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granulite.operators.ordered import group_totals, row_index, time_chunk
from granulite.queries.registry import table

# gain and offset of the stretch per label
STRETCH = {0: (10.0, 10.0), 1: (10.0, 252.0), 2: (8.0, 45.0), 3: (8.0, 120.0)}
OTHER = (127.5, 127.5)


def frames8(spark: SparkSession, sf: str) -> DataFrame:
    """``embeddings`` as 8x8 gray frames, in lines."""
    def pick(k):
        c = F.lit(OTHER[k])
        for lab, v in STRETCH.items():
            c = F.when(F.col("label") == lab, F.lit(v[k])).otherwise(c)
        return c
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", pick(0).alias("g"), pick(1).alias("o"))

    def gray(x):
        v = F.floor(x.cast("double") * F.col("g") + F.col("o")).cast("double")
        return F.least(F.lit(255.0), F.greatest(F.lit(0.0), v))
    lines = F.transform(F.sequence(F.lit(0), F.lit(7)),
                        lambda y: F.transform(F.slice("embedding", y * 8 + 1, 8), gray))
    return e.select(F.col("vec_id").alias("frame_id"), F.lit(8).alias("height"), F.posexplode(lines).alias("y", "vals"))


_CASE = {k: " ".join(f"WHEN {lab} THEN {v[k]}" for lab, v in STRETCH.items()) for k in (0, 1)}
FRAMES8 = f"""
emb AS (SELECT vec_id AS frame_id, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) - 1 AS pos,
        CASE label {_CASE[0]} ELSE {OTHER[0]} END::DOUBLE AS g,
        CASE label {_CASE[1]} ELSE {OTHER[1]} END::DOUBLE AS o FROM embeddings),
px AS (SELECT frame_id, pos // 8 AS y, pos % 8 AS x, 8 AS h, 8 AS w,
       least(255.0::DOUBLE, greatest(0.0::DOUBLE, floor(e * g + o))) AS v FROM emb)"""


def refl(i: str, n: str) -> str:
    """SQL of the mirrored index."""
    p = f"greatest(2*({n}-1), 1)"
    m = f"((({i}) % {p} + {p}) % {p})"
    return f"(CASE WHEN {n} <= 1 THEN 0 WHEN {m} < {n} THEN {m} ELSE {p} - {m} END)"


def blur_sql(src: str, dst: str, taps: str, r: int, u8: bool = True) -> str:
    """SQL of a separable filter: ``taps(d, w)`` with d from -r to r."""
    v = "floor(sum(t.w * s.v) + 0.5)" if u8 else "sum(t.w * s.v)"
    return f"""
{dst}_h AS (SELECT a.frame_id, a.y, a.x, a.h, a.w, sum(t.w * s.v) AS v FROM {src} a, {taps} t, {src} s
   WHERE s.frame_id = a.frame_id AND s.y = a.y AND s.x = {refl('a.x + t.d', 'a.w')} GROUP BY ALL),
{dst} AS (SELECT a.frame_id, a.y, a.x, a.h, a.w, {v} AS v FROM {dst}_h a, {taps} t, {dst}_h s
   WHERE s.frame_id = a.frame_id AND s.x = a.x AND s.y = {refl('a.y + t.d', 'a.h')} GROUP BY ALL)"""


def taps_sql(name: str, k: int, sigma: float = 0.0) -> str:
    if k in (3, 5) and sigma <= 0:
        w = {3: "(-1,0.25),(0,0.5),(1,0.25)", 5: "(-2,0.0625),(-1,0.25),(0,0.375),(1,0.25),(2,0.0625)"}[k]
        return f"{name} AS (SELECT d::INT AS d, w::DOUBLE AS w FROM (VALUES {w}) q(d, w))"
    if k == 0:
        k = round(sigma * 8 + 1) | 1
    if sigma <= 0:
        sigma = 0.3 * ((k - 1) * 0.5 - 1) + 0.8
    r = k // 2
    e = f"exp(-(d*d)/(2*{sigma!r}::DOUBLE*{sigma!r}::DOUBLE))"
    return f"""{name} AS (SELECT d::INT AS d, {e} / sum({e}) OVER () AS w
   FROM (SELECT unnest(generate_series(-{r}, {r})) AS d))"""


def sobel_sql(src: str, dst: str) -> str:
    return f"""
{dst}_n AS (SELECT a.frame_id, a.y, a.x, a.h, a.w, k.dy, k.dx, s.v FROM {src} a,
   (SELECT unnest([-1,0,1]) AS dy) k0, LATERAL (SELECT k0.dy AS dy, unnest([-1,0,1]) AS dx) k, {src} s
   WHERE s.frame_id = a.frame_id AND s.y = {refl('a.y + k.dy', 'a.h')} AND s.x = {refl('a.x + k.dx', 'a.w')}),
{dst} AS (SELECT frame_id, y, x, h, w, sqrt(sum(v*dx*(2-abs(dy)))*sum(v*dx*(2-abs(dy)))
   + sum(v*dy*(2-abs(dx)))*sum(v*dy*(2-abs(dx)))) AS v FROM {dst}_n GROUP BY ALL)"""


def series(spark: SparkSession, sf: str) -> DataFrame:
    """``events`` per user as scan points: sobel = value, lap = k of props, z falling."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "value",
                                          F.get_json_object("props", "$.k").cast("double").alias("lap"))
    e = row_index(e.withColumn("_chunk", time_chunk("ts")), ["user_id"], ["ts", "event_id"], "_chunk", "i")
    e = group_totals(e, ["user_id"], F.count("*").alias("n"))
    return e.select(F.col("user_id").alias("scan_id"), "i", (F.col("n") - F.col("i")).cast("double").alias("z"),
                    F.col("value").alias("sobel"), "lap")


SERIES = """
pts AS (SELECT user_id AS scan_id, row_number() OVER w - 1 AS i,
   (count(*) OVER (PARTITION BY user_id) - (row_number() OVER w - 1))::DOUBLE AS z,
   value AS sobel, json_extract_string(props, '$.k')::DOUBLE AS lap FROM events
   WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
