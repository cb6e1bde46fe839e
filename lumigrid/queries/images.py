"""Relational image features over the pixel relation (grid cells are a quarter of its side)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumigrid.functions import pixels as X
from lumigrid.functions import vectors as V
from lumigrid.plans.corpus import pixels
from lumigrid.queries.base import PIXELS, query, r6

_DEG = "CASE WHEN v = r THEN 60.0 * (g - b) / nullif(v - lo, 0) WHEN v = g THEN 120.0 + 60.0 * (b - r) / nullif(v - lo, 0) ELSE 240.0 + 60.0 * (r - g) / nullif(v - lo, 0) END"
_COLORS = f"c0 AS (SELECT *, greatest(b, g, r)::DOUBLE AS v, least(b, g, r)::DOUBLE AS lo, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS gray FROM pixels), c AS (SELECT img_id, y, x, b, g, r, gray, v, coalesce(255.0 * (v - lo) / nullif(v, 0), 0.0) AS s, coalesce(CASE WHEN deg < 0 THEN deg + 360 ELSE deg END, 0.0) / 2 AS h, (y // 4) * 4 + x // 4 AS cell FROM (SELECT *, {_DEG} AS deg FROM c0))"
_LONG = "ch AS (SELECT img_id, y, x, cell, 'b' AS channel, b::DOUBLE AS value FROM c UNION ALL SELECT img_id, y, x, cell, 'g', g FROM c UNION ALL SELECT img_id, y, x, cell, 'r', r FROM c UNION ALL SELECT img_id, y, x, cell, 'gray', gray FROM c)"
BASE = (*PIXELS, _COLORS)
LONG = (*BASE, _LONG)


def _rounded(df, *keys, places=6):
    return df.select(*keys, *[V.rounded(F.col(c).cast("double"), places).alias(c) for c in df.columns if c not in keys])


def image(name, sql, ctes, *keys, places=6):
    """Registers an image query whose columns but the keys are rounded."""

    def register(f):
        query(f"image_{name}", sql, ctes)(lambda spark, sf_dir: _rounded(f(pixels(spark)), *keys, places=places))
        return f

    return register


image("basics", f"SELECT img_id, {r6('avg(v) / 255')} AS brightness, {r6('least(1.0, stddev_pop(gray) / 127.5)')} AS contrast, {r6('avg(s) / 255')} AS saturation FROM c GROUP BY img_id", BASE, "img_id")(X.basics)

_P = "p AS (SELECT *, value / 32 - 0.5 AS p FROM ch), w AS (SELECT img_id, channel, greatest(0, least(7, floor(p)))::BIGINT AS bin, 1 - (p - floor(p)) AS w FROM p UNION ALL SELECT img_id, channel, greatest(0, least(7, floor(p) + 1))::BIGINT, p - floor(p) FROM p), sh AS (SELECT img_id, channel, bin, sum(w) / (sum(sum(w)) OVER (PARTITION BY img_id, channel) + 1e-7) AS share FROM w GROUP BY img_id, channel, bin)"
image("soft_histogram", f"SELECT img_id, channel, bin, {r6('share')} AS share, {r6('sum(share) OVER (PARTITION BY img_id, channel ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS cdf FROM sh", (*LONG, _P), "img_id", "channel", "bin")(X.soft_histogram)


def _corner(c: str, k: int) -> tuple[str, str]:
    p = f"({c} / 64.0::DOUBLE - 0.5)"
    return f"greatest(0, least(3, floor({p}) + {k}))::BIGINT", f"({p} - floor({p}))" if k else f"(1 - ({p} - floor({p})))"


_CORNERS = " UNION ALL ".join(f"SELECT img_id, {_corner('r', i)[0]} AS rb, {_corner('g', j)[0]} AS gb, {_corner('b', k)[0]} AS bb, {_corner('r', i)[1]} * {_corner('g', j)[1]} * {_corner('b', k)[1]} AS w FROM pixels" for i in (0, 1) for j in (0, 1) for k in (0, 1))
image("joint_soft_histogram", f"SELECT img_id, rb, gb, bb, {r6('sum(w) / sum(sum(w)) OVER (PARTITION BY img_id)')} AS share FROM ({_CORNERS}) GROUP BY img_id, rb, gb, bb", PIXELS, "img_id", "rb", "gb", "bb")(X.joint_soft_histogram)
image("cells", f"SELECT img_id, cell, {r6('avg(b)')} AS b, {r6('avg(g)')} AS g, {r6('avg(r)')} AS r, {r6('avg(gray)')} AS gray FROM c GROUP BY img_id, cell", BASE, "img_id", "cell")(X.cells)
image("moments", f"SELECT img_id, channel, {r6('mean')} AS mean, {r6('std')} AS std, {r6('avg((value - mean) ^ 3) / (std ^ 3 + 1e-7)')} AS skew FROM ch JOIN (SELECT img_id, channel, avg(value) AS mean, stddev_pop(value) AS std FROM ch GROUP BY img_id, channel) USING (img_id, channel) GROUP BY img_id, channel, mean, std", LONG, "img_id", "channel")(X.moments)

_ORD = [(2, 0), (1, 1), (0, 2), (3, 0), (2, 1), (1, 2), (0, 3)]
_MU = "bw AS (SELECT img_id, x, y, CASE WHEN gray > 128 THEN 255.0::DOUBLE ELSE 0 END AS p FROM c), mm AS (SELECT img_id, sum(p) AS m00, sum(x * p) AS m10, sum(y * p) AS m01 FROM bw GROUP BY img_id), nn AS (SELECT img_id, " + ", ".join(f"coalesce(sum((x - m10 / nullif(m00, 0)) ^ {i} * (y - m01 / nullif(m00, 0)) ^ {j} * p) / nullif(max(m00) ^ {1 + (i + j) / 2}, 0), 0.0) AS n{i}{j}" for i, j in _ORD) + " FROM bw JOIN mm USING (img_id) GROUP BY img_id)"
_A, _B, _P3, _Q3 = "(n30 + n12)", "(n21 + n03)", "(n30 - 3 * n12)", "(3 * n21 - n03)"
_HU = [
    "n20 + n02", "(n20 - n02) ^ 2 + 4 * n11 ^ 2", f"{_P3} ^ 2 + {_Q3} ^ 2", f"{_A} ^ 2 + {_B} ^ 2", f"{_P3} * {_A} * ({_A} ^ 2 - 3 * {_B} ^ 2) + {_Q3} * {_B} * (3 * {_A} ^ 2 - {_B} ^ 2)",
    f"(n20 - n02) * ({_A} ^ 2 - {_B} ^ 2) + 4 * n11 * {_A} * {_B}", f"{_Q3} * {_A} * ({_A} ^ 2 - 3 * {_B} ^ 2) - {_P3} * {_B} * (3 * {_A} ^ 2 - {_B} ^ 2)",
]
# the higher invariants are differences of nearly equal numbers, so three places are compared


@query("image_hu_moments", "SELECT img_id, " + ", ".join(f"round(-sign({h}) * log10(abs({h}) + 1e-12), 3) + 0.0 AS hu{i + 1}" for i, h in enumerate(_HU[:4])) + " FROM nn", (*BASE, _MU))
def image_hu_moments(spark, sf_dir):
    return X.hu_moments(pixels(spark)).select("img_id", *[V.rounded(F.col(f"hu{i}"), 3).alias(f"hu{i}") for i in range(1, 5)])


def _lagged(col: str, by: str, along: str, step: int) -> str:
    w = f"OVER (PARTITION BY img_id, {by} ORDER BY {along})"
    f, g = ("lead", "lag") if step > 0 else ("lag", "lead")
    return f"coalesce({f}({col}) {w}, {g}({col}) {w})"


_rx = lambda c, s: _lagged(c, "y", "x", s)
_cy = lambda c, s: _lagged(c, "x", "y", s)
image("sharpness", f"SELECT img_id, {r6('var_pop(l)')} AS sharpness FROM (SELECT img_id, {_rx('gray', 1)} + {_rx('gray', -1)} + {_cy('gray', 1)} + {_cy('gray', -1)} - 4 * gray AS l FROM c) GROUP BY img_id", BASE, "img_id")(X.sharpness)

_SOBEL = f"so0 AS (SELECT img_id, y, x, {_rx('gray', 1)} - {_rx('gray', -1)} AS dx, {_rx('gray', 1)} + 2 * gray + {_rx('gray', -1)} AS sx FROM c), so AS (SELECT img_id, y, x, {_cy('dx', 1)} + 2 * dx + {_cy('dx', -1)} AS gx, {_cy('sx', 1)} - {_cy('sx', -1)} AS gy FROM so0)"
image("sobel", f"SELECT img_id, y, x, {r6('gx')} AS gx, {r6('gy')} AS gy FROM so", (*BASE, _SOBEL), "img_id", "y", "x")(X.sobel)
_EDGE = "eo AS (SELECT img_id, sqrt(gx ^ 2 + gy ^ 2) AS mag, max(sqrt(gx ^ 2 + gy ^ 2)) OVER (PARTITION BY img_id) AS top, round(CASE WHEN degrees(atan2(gy, gx)) < 0 THEN degrees(atan2(gy, gx)) + 180 WHEN degrees(atan2(gy, gx)) >= 180 THEN 0 ELSE degrees(atan2(gy, gx)) END, 9) AS deg FROM so), ek AS (SELECT img_id, CASE WHEN mag > top * 0.1 THEN CASE WHEN deg < 22.5 OR deg >= 157.5 THEN 0 WHEN deg >= 67.5 AND deg < 112.5 THEN 1 WHEN deg >= 22.5 AND deg < 67.5 THEN 2 ELSE 3 END END AS kind FROM eo)"
image("edge_orientation", "SELECT img_id, " + ", ".join(f"{r6(f'count(*) FILTER (kind = {i}) * 1.0 / count(*)')} AS {n}" for i, n in enumerate(("e0", "e90", "e45", "e135"))) + f", {r6('count(*) FILTER (kind IS NULL) * 1.0 / count(*)')} AS none FROM ek GROUP BY img_id", (*BASE, _SOBEL, _EDGE), "img_id")(X.edge_orientation)

_GL = "gl0 AS (SELECT img_id, cell, i, lead(i) OVER (PARTITION BY img_id, cell, y ORDER BY x) AS j FROM (SELECT *, floor(gray / 8) AS i FROM c)), gl1 AS (SELECT img_id, cell, i, j FROM gl0 WHERE j IS NOT NULL UNION ALL SELECT img_id, cell, j, i FROM gl0 WHERE j IS NOT NULL), gp AS (SELECT img_id, cell, i, j, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY img_id, cell) AS p FROM gl1 GROUP BY img_id, cell, i, j), gs AS (SELECT img_id, cell, sum(p * (i - j) ^ 2) AS contrast, sum(p * i) AS mu, sum(p * i ^ 2) AS ii, sum(p * i * j) AS ij, sqrt(sum(p ^ 2)) AS energy, sum(p / (1 + (i - j) ^ 2)) AS homogeneity FROM gp GROUP BY img_id, cell)"
image("glcm", f"SELECT img_id, cell, {r6('contrast')} AS contrast, {r6('CASE WHEN ii - mu ^ 2 < 1e-12 THEN 1.0 ELSE (ij - mu ^ 2) / nullif(ii - mu ^ 2, 0) END')} AS correlation, {r6('energy')} AS energy, {r6('homogeneity')} AS homogeneity FROM gs", (*BASE, _GL), "img_id", "cell")(X.glcm)


def _level(n: int, source: str) -> str:
    at = lambda a, b: f"max(CASE WHEN y % 2 = {a} AND x % 2 = {b} THEN p END)"
    return f"q{n} AS (SELECT img_id, y // 2 AS y, x // 2 AS x, avg(p) AS p, abs({at(0, 1)} - {at(1, 1)}) AS lh, abs({at(1, 0)} - {at(1, 1)}) AS hl, abs({at(0, 0)} - {at(1, 1)}) AS hh FROM {source} GROUP BY img_id, y // 2, x // 2)"


_WAVE = ("q0 AS (SELECT img_id, y, x, gray AS p FROM c)", _level(1, "q0"), _level(2, "q1"), _level(3, "q2"))
# means of few-digit decimals often end in a 5 at the seventh place; ten places hold them whole
image("wavelet", " UNION ALL ".join("SELECT img_id, %d AS level, " % n + ", ".join(f"round(avg({c}), 10) + 0.0 AS {a}" for c, a in (("p", "ll"), ("lh", "lh"), ("hl", "hl"), ("hh", "hh"))) + f" FROM q{n} GROUP BY img_id" for n in (1, 2, 3)), (*BASE, *_WAVE), "img_id", "level", places=10)(X.wavelet)

_CORR = "hq AS (SELECT img_id, y, x, floor(h / 22.5)::BIGINT AS color FROM c), an AS (SELECT * FROM hq WHERE y % 2 = 0 AND x % 2 = 0), st AS (SELECT * FROM (VALUES " + ", ".join(f"({d}, {dy}, {dx})" for d in (1, 3, 5, 7) for dy, dx in ((0, d), (d, 0), (d, d), (-d, d))) + ") t(d, dy, dx)), tot AS (SELECT img_id, color, count(*) AS total FROM an GROUP BY img_id, color)"
image("correlogram", f"SELECT a.img_id, st.d::BIGINT AS d, a.color, {r6('count(o.color) / (4 * max(tot.total) + 1e-7)')} AS share FROM an a CROSS JOIN st JOIN tot ON tot.img_id = a.img_id AND tot.color = a.color LEFT JOIN hq o ON o.img_id = a.img_id AND o.y = a.y + st.dy AND o.x = a.x + st.dx AND o.color = a.color GROUP BY a.img_id, st.d, a.color", (*BASE, _CORR), "img_id", "d", "color")(X.correlogram)

_DCT = "sm AS (SELECT img_id, y // 2 AS y, x // 2 AS x, avg(gray) AS p FROM c GROUP BY 1, 2, 3), ba AS (SELECT k.range AS k, n.range AS n, CASE WHEN k.range = 0 THEN sqrt(1 / 8.0) ELSE sqrt(2 / 8.0) END * cos(pi() * (2 * n.range + 1) * k.range / 16.0) AS c FROM range(8) k, range(8) n), ro AS (SELECT img_id, y, k AS v, sum(p * c) AS p FROM sm JOIN ba ON x = n GROUP BY 1, 2, 3)"
image("color_layout", f"SELECT img_id, k AS u, v, {r6('sum(p * c)')} AS coef FROM ro JOIN ba ON y = n GROUP BY 1, 2, 3", (*BASE, _DCT), "img_id", "u", "v")(X.color_layout)

_PYR = "py AS (SELECT img_id, least(floor(h / 5.625), 31)::BIGINT AS bin, 1 + (y // 8) * 2 + x // 8 AS region FROM c), pr AS (SELECT img_id, bin, region FROM py UNION ALL SELECT img_id, bin, 0 FROM py), pn AS (SELECT img_id, region, bin, count(*) AS n FROM pr GROUP BY 1, 2, 3)"
image("spatial_pyramid", f"SELECT img_id, region, bin, {r6('n / sqrt(sum(n * n) OVER (PARTITION BY img_id, region))')} AS share FROM pn", (*BASE, _PYR), "img_id", "region", "bin")(X.spatial_pyramid)
image("dominant_color", f"SELECT img_id, {r6('avg(b)')} AS b, {r6('avg(g)')} AS g, {r6('avg(r)')} AS r FROM pixels GROUP BY img_id", PIXELS, "img_id")(X.dominant_color)
_GAUSS = "ga AS (SELECT img_id, i.range AS bin, sum(exp(-((gray - (i.range + 0.5) * 32) ^ 2) / 512.0)) AS w FROM c, range(8) i GROUP BY 1, 2)"
image("gaussian_histogram", f"SELECT img_id, bin::INT AS bin, {r6('w / (sum(w) OVER (PARTITION BY img_id) + 1e-7)')} AS share FROM ga", (*BASE, _GAUSS), "img_id", "bin")(X.gaussian_histogram)
image("joint_histogram", f"SELECT img_id, r // 64 AS rb, g // 64 AS gb, b // 64 AS bb, {r6('count(*) / sum(count(*)) OVER (PARTITION BY img_id)')} AS share FROM pixels GROUP BY 1, 2, 3, 4", PIXELS, "img_id", "rb", "gb", "bb")(X.joint_histogram)
_CH = "hn AS (SELECT img_id, cell, channel, floor(value / 32)::BIGINT AS bin, count(*) AS n FROM ch WHERE channel <> 'gray' GROUP BY 1, 2, 3, 4)"
image("cell_histograms", f"SELECT img_id, cell, channel, bin, {r6('n / sum(n) OVER (PARTITION BY img_id, cell, channel)')} AS share, {r6('sum(n) OVER (PARTITION BY img_id, cell, channel ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(n) OVER (PARTITION BY img_id, cell, channel)')} AS cdf FROM hn", (*LONG, _CH), "img_id", "cell", "channel", "bin")(X.cell_histograms)


@query("image_extractors")
def image_extractors(spark, sf_dir):
    """Every NumPy extractor over images given as bytes: (img_id, feature, place, value)."""
    from lumigrid.functions.extractors import EXTRACTORS
    from lumigrid.plans.corpus import pixels
    from lumigrid.sources import images

    at = pixels(spark).select("img_id", F.struct("y", "x").alias("at"), F.concat(*[F.lpad(F.hex(c), 2, "0") for c in "bgr"]).alias("said"))
    hexed = at.groupBy("img_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "said"))), lambda x: x["said"]), "").alias("all"))
    files = hexed.select(F.col("img_id").cast("string").alias("origin"), F.lit(16).alias("height"), F.lit(16).alias("width"), F.lit(3).alias("channels"), F.unhex("all").alias("data"))
    wide = images.extracted(files, scale=1).where("error is null")
    each = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("v")) for f in EXTRACTORS])
    long = wide.select(F.col("origin").cast("long").alias("img_id"), F.explode(each).alias("e")).select("img_id", "e.feature", F.posexplode("e.v").alias("place", "value"))
    return long.withColumn("value", F.round(F.col("value").cast("double"), 4) + F.lit(0.0))
