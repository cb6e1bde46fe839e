"""Image features as relational plans over pixels (img_id, y, x, b, g, r).

Every feature is a grouped aggregate or a window within an image, so images are spread over tasks and nothing but the
pixel table is shuffled. Values are floating point throughout: no 8-bit rounding in between. Grids are 4 x 4 cells of
the image's own size `side`.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TINY = 1e-7


def with_colors(px: DataFrame) -> DataFrame:
    """Adds gray, v (0 to 255), s (0 to 255) and h (0 to 180)."""
    b, g, r = F.col("b"), F.col("g"), F.col("r")
    hi, lo = F.greatest(b, g, r).cast("double"), F.least(b, g, r).cast("double")
    d = F.nullif(hi - lo, F.lit(0.0))
    deg = F.when(hi == r, 60.0 * (g - b) / d).when(hi == g, 120.0 + 60.0 * (b - r) / d).otherwise(240.0 + 60.0 * (r - g) / d)
    h = F.coalesce(F.when(deg < 0, deg + 360.0).otherwise(deg), F.lit(0.0)) / 2.0
    return px.withColumns({"gray": 0.299 * r + 0.587 * g + 0.114 * b, "v": hi, "s": F.coalesce(255.0 * d / F.nullif(hi, F.lit(0.0)), F.lit(0.0)), "h": h})


def basics(px: DataFrame) -> DataFrame:
    """(img_id, brightness, contrast, saturation)"""
    return with_colors(px).groupBy("img_id").agg((F.avg("v") / 255.0).alias("brightness"), F.least(F.lit(1.0), F.stddev_pop("gray") / 127.5).alias("contrast"), (F.avg("s") / 255.0).alias("saturation"))


def channels(px: DataFrame) -> DataFrame:
    """(img_id, y, x, channel, value): blue, green, red and gray in long form."""
    return with_colors(px).selectExpr("img_id", "y", "x", "stack(4, 'b', CAST(b AS DOUBLE), 'g', CAST(g AS DOUBLE), 'r', CAST(r AS DOUBLE), 'gray', gray) AS (channel, value)")


def _soft(value: Column, bins: int, width: float) -> tuple[Column, Column, Column]:
    """The two bins next to a value (clamped), and the share of the upper one."""
    p = value / width - 0.5
    low = F.floor(p)
    clamp = lambda k: F.greatest(F.lit(0), F.least(F.lit(bins - 1), k)).cast("long")
    return clamp(low), clamp(low + 1), p - low


def soft_histogram(px: DataFrame, bins: int = 8) -> DataFrame:
    """(img_id, channel, bin, share, cdf): each value is split between the two nearest of `bins` over 0..256; cdf adds
    shares up within the channel."""
    low, high, part = _soft(F.col("value"), bins, 256 / bins)
    split = channels(px).select("img_id", "channel", F.explode(F.array(F.struct(low.alias("bin"), (1 - part).alias("w")), F.struct(high.alias("bin"), part.alias("w")))).alias("e"))
    sums = split.groupBy("img_id", "channel", F.col("e.bin").alias("bin")).agg(F.sum("e.w").alias("w"))
    share = F.col("w") / (F.sum("w").over(Window.partitionBy("img_id", "channel")) + TINY)
    up = Window.partitionBy("img_id", "channel").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return sums.withColumn("share", share).withColumn("cdf", F.sum("share").over(up)).drop("w")


def joint_soft_histogram(px: DataFrame, bins: int = 4) -> DataFrame:
    """(img_id, rb, gb, bb, share): trilinear shares over bins x bins x bins of red, green, blue."""
    parts = {c: _soft(F.col(c).cast("double"), bins, 256 / bins) for c in "rgb"}
    corners = [F.struct(*[parts[c][k].alias(f"{c}b") for c, k in zip("rgb", ks, strict=True)], reduce(lambda a, b: a * b, [parts[c][2] if k else 1 - parts[c][2] for c, k in zip("rgb", ks, strict=True)]).alias("w")) for ks in [(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]]
    e = px.select("img_id", F.explode(F.array(*corners)).alias("e")).groupBy("img_id", "e.rb", "e.gb", "e.bb").agg(F.sum("e.w").alias("w"))
    return e.select("img_id", "rb", "gb", "bb", (F.col("w") / F.sum("w").over(Window.partitionBy("img_id"))).alias("share"))


def _cell(side: int) -> Column:
    return (F.floor(F.col("y") / (side // 4)) * 4 + F.floor(F.col("x") / (side // 4))).cast("long")


def cells(px: DataFrame, side: int = 16) -> DataFrame:
    """(img_id, cell, b, g, r, gray): means over the 4 x 4 grid."""
    return with_colors(px).groupBy("img_id", _cell(side).alias("cell")).agg(*[F.avg(c).alias(c) for c in ("b", "g", "r", "gray")])


def moments(px: DataFrame) -> DataFrame:
    """(img_id, channel, mean, std, skew): population deviation, skew with a small constant under the cube."""
    c = channels(px)
    m = c.groupBy("img_id", "channel").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    third = c.join(m, ["img_id", "channel"]).groupBy("img_id", "channel", "mean", "std").agg(F.avg(F.pow(F.col("value") - F.col("mean"), F.lit(3.0))).alias("m3"))
    return third.select("img_id", "channel", "mean", "std", (F.col("m3") / (F.pow("std", F.lit(3.0)) + TINY)).alias("skew"))


def hu_moments(px: DataFrame, threshold: float = 128.0) -> DataFrame:
    """(img_id, hu1 ... hu7): -sign(h) log10(|h| + 1e-12) of the invariants of the thresholded image."""
    on = with_colors(px).select("img_id", "x", "y", F.when(F.col("gray") > threshold, 255.0).otherwise(0.0).alias("p"))
    m = on.groupBy("img_id").agg(F.sum("p").alias("m00"), F.sum(F.col("x") * F.col("p")).alias("m10"), F.sum(F.col("y") * F.col("p")).alias("m01"))
    c = on.join(m, "img_id").withColumn("dx", F.col("x") - F.col("m10") / F.nullif(F.col("m00"), F.lit(0.0))).withColumn("dy", F.col("y") - F.col("m01") / F.nullif(F.col("m00"), F.lit(0.0)))
    orders = [(2, 0), (1, 1), (0, 2), (3, 0), (2, 1), (1, 2), (0, 3)]
    mu = c.groupBy("img_id", "m00").agg(*[F.coalesce(F.sum(F.pow("dx", F.lit(float(i))) * F.pow("dy", F.lit(float(j))) * F.col("p")), F.lit(0.0)).alias(f"u{i}{j}") for i, j in orders])
    n = {(i, j): F.coalesce(F.col(f"u{i}{j}") / F.nullif(F.pow("m00", F.lit(1 + (i + j) / 2)), F.lit(0.0)), F.lit(0.0)) for i, j in orders}
    e = mu.select("img_id", *[n[k].alias(f"n{k[0]}{k[1]}") for k in orders])
    n20, n11, n02, n30, n21, n12, n03 = (F.col(f"n{i}{j}") for i, j in orders)
    a, b = n30 + n12, n21 + n03
    p, q = n30 - 3 * n12, 3 * n21 - n03
    hu = [
        n20 + n02, (n20 - n02) ** 2 + 4 * n11**2, p**2 + q**2, a**2 + b**2, p * a * (a**2 - 3 * b**2) + q * b * (3 * a**2 - b**2),
        (n20 - n02) * (a**2 - b**2) + 4 * n11 * a * b, q * a * (a**2 - 3 * b**2) - p * b * (3 * a**2 - b**2),
    ]
    return e.select("img_id", *[(-F.signum(h) * F.log10(F.abs(h) + 1e-12)).alias(f"hu{i + 1}") for i, h in enumerate(hu)])


def _row(step: int, col: str) -> Column:
    """The value `step` columns on, mirrored at the border."""
    w = Window.partitionBy("img_id", "y").orderBy("x")
    return F.coalesce(F.lag(col, -step).over(w), F.lag(col, step).over(w))


def _column(step: int, col: str) -> Column:
    w = Window.partitionBy("img_id", "x").orderBy("y")
    return F.coalesce(F.lag(col, -step).over(w), F.lag(col, step).over(w))


def sharpness(px: DataFrame) -> DataFrame:
    """(img_id, sharpness): variance of the four-neighbour Laplacian of gray."""
    g = with_colors(px).select("img_id", "y", "x", "gray")
    lap = g.withColumn("row", _row(1, "gray") + _row(-1, "gray")).withColumn("col", _column(1, "gray") + _column(-1, "gray"))
    return lap.groupBy("img_id").agg(F.var_pop(F.col("row") + F.col("col") - 4 * F.col("gray")).alias("sharpness"))


def sobel(px: DataFrame) -> DataFrame:
    """(img_id, y, x, gx, gy): 3 x 3 Sobel gradients of gray, mirrored at the border."""
    g = with_colors(px).select("img_id", "y", "x", "gray")
    a = g.withColumn("dx", _row(1, "gray") - _row(-1, "gray")).withColumn("sx", _row(1, "gray") + 2 * F.col("gray") + _row(-1, "gray"))
    return a.select("img_id", "y", "x", (_column(1, "dx") + 2 * F.col("dx") + _column(-1, "dx")).alias("gx"), (_column(1, "sx") - _column(-1, "sx")).alias("gy"))


def edge_orientation(px: DataFrame) -> DataFrame:
    """(img_id, e0, e90, e45, e135, none): shares of edge directions, and of pixels under a tenth of the strongest edge."""
    m = sobel(px).withColumn("mag", F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2)).withColumn("top", F.max("mag").over(Window.partitionBy("img_id")))
    deg = F.degrees(F.atan2("gy", "gx"))
    m = m.withColumn("edge", F.col("mag") > F.col("top") * 0.1).withColumn("deg", F.round(F.pmod(deg, F.lit(180.0)), 9))
    d = F.col("deg")
    kind = F.when((d < 22.5) | (d >= 157.5), 0).when(d.between(67.5, 112.5) & (d < 112.5), 1).when((d >= 22.5) & (d < 67.5), 2).otherwise(3)
    k = m.withColumn("kind", F.when(F.col("edge"), kind))
    n = F.count(F.lit(1))
    shares = [(F.count_if(F.col("kind") == i) / n).alias(name) for i, name in enumerate(("e0", "e90", "e45", "e135"))]
    return k.groupBy("img_id").agg(*shares, (F.count_if(F.col("kind").isNull()) / n).alias("none"))


def glcm(px: DataFrame, side: int = 16) -> DataFrame:
    """(img_id, cell, contrast, correlation, energy, homogeneity) of symmetric neighbour pairs at distance 1 to the right, 32 levels."""
    q = with_colors(px).select("img_id", "y", "x", _cell(side).alias("cell"), F.floor(F.col("gray") / 8).alias("i"))
    pair = q.withColumn("j", F.lead("i").over(Window.partitionBy("img_id", "cell", "y").orderBy("x"))).where("j is not null")
    both = pair.select("img_id", "cell", F.explode(F.array(F.struct(F.col("i"), F.col("j")), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("e")).groupBy("img_id", "cell", "e.i", "e.j").agg(F.count(F.lit(1)).alias("n"))
    p = both.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("img_id", "cell")))
    diff = F.pow(F.col("i") - F.col("j"), F.lit(2.0))
    s = p.groupBy("img_id", "cell").agg(
        F.sum(F.col("p") * diff).alias("contrast"), F.sum(F.col("p") * F.col("i")).alias("mu"), F.sum(F.col("p") * F.col("i") ** 2).alias("ii"), F.sum(F.col("p") * F.col("i") * F.col("j")).alias("ij"),
        F.sqrt(F.sum(F.col("p") ** 2)).alias("energy"), F.sum(F.col("p") / (1 + diff)).alias("homogeneity"),
    )
    var = F.col("ii") - F.col("mu") ** 2
    corr = F.when(var < 1e-12, 1.0).otherwise((F.col("ij") - F.col("mu") ** 2) / F.nullif(var, F.lit(0.0)))
    return s.select("img_id", "cell", "contrast", corr.alias("correlation"), "energy", "homogeneity")


def wavelet(px: DataFrame, levels: int = 3) -> DataFrame:
    """(img_id, level, ll, lh, hl, hh): means of 2 x 2 averages and of absolute differences to the lower right pixel."""
    now, out = with_colors(px).select("img_id", "y", "x", F.col("gray").alias("p")), None
    at = lambda a, b: F.max(F.when((F.col("y") % 2 == a) & (F.col("x") % 2 == b), F.col("p")))
    for level in range(1, levels + 1):
        d = at(1, 1)
        quad = now.groupBy("img_id", F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x")).agg(F.avg("p").alias("p"), F.abs(at(0, 1) - d).alias("lh"), F.abs(at(1, 0) - d).alias("hl"), F.abs(at(0, 0) - d).alias("hh"))
        row = quad.groupBy("img_id").agg(F.avg("p").alias("ll"), F.avg("lh").alias("lh"), F.avg("hl").alias("hl"), F.avg("hh").alias("hh")).withColumn("level", F.lit(level))
        out = row if out is None else out.unionByName(row)
        now = quad.select("img_id", "y", "x", "p")
    return out


def correlogram(px: DataFrame, distances: tuple[int, ...] = (1, 3, 5, 7)) -> DataFrame:
    """(img_id, d, color, share): how many of four neighbours at distance d of every other pixel share its hue bin."""
    q = with_colors(px).select("img_id", "y", "x", F.floor(F.col("h") / 22.5).alias("color"))
    anchors = q.where("y % 2 = 0 and x % 2 = 0")
    steps = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for d in distances for dy, dx in ((0, d), (d, 0), (d, d), (-d, d))])
    asked = anchors.select("img_id", "color", "y", "x", F.explode(steps).alias("s")).select("img_id", "color", F.col("s.d").alias("d"), (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    met = asked.join(q.withColumnRenamed("color", "other"), ["img_id", "y", "x"], "left")
    total = anchors.groupBy("img_id", "color").agg(F.count(F.lit(1)).alias("total"))
    same = met.groupBy("img_id", "color", "d").agg(F.count_if(F.col("color") == F.col("other")).alias("same"))
    return same.join(total, ["img_id", "color"]).select("img_id", F.col("d").cast("long").alias("d"), "color", (F.col("same") / (4 * F.col("total") + TINY)).alias("share"))


def color_layout(px: DataFrame, side: int = 16, size: int = 8) -> DataFrame:
    """(img_id, u, v, coef): two-dimensional orthonormal cosine transform of luma at size x size."""
    f = side // size
    small = with_colors(px).groupBy("img_id", F.floor(F.col("y") / f).alias("y"), F.floor(F.col("x") / f).alias("x")).agg(F.avg("gray").alias("p"))
    spark = px.sparkSession
    basis = spark.range(size).select(F.col("id").alias("k")).join(spark.range(size).select(F.col("id").alias("n")), F.lit(True))
    scale = F.when(F.col("k") == 0, math.sqrt(1 / size)).otherwise(math.sqrt(2 / size))
    basis = F.broadcast(basis.select("k", "n", (scale * F.cos(F.lit(math.pi) * (2 * F.col("n") + 1) * F.col("k") / (2 * size))).alias("c")))  # size x size rows
    rows = small.join(basis, F.col("x") == F.col("n")).groupBy("img_id", "y", F.col("k").alias("v")).agg(F.sum(F.col("p") * F.col("c")).alias("p"))
    return rows.join(basis, F.col("y") == F.col("n")).groupBy("img_id", F.col("k").alias("u"), "v").agg(F.sum(F.col("p") * F.col("c")).alias("coef"))


def spatial_pyramid(px: DataFrame, side: int = 16, bins: int = 32) -> DataFrame:
    """(img_id, region, bin, share): hue histograms of the whole (region 0) and of its quarters (1 to 4), of unit length."""
    b = with_colors(px).select("img_id", F.least(F.floor(F.col("h") / (180 / bins)), F.lit(bins - 1)).alias("bin"), (1 + F.floor(F.col("y") / (side // 2)) * 2 + F.floor(F.col("x") / (side // 2))).alias("quarter"))
    n = b.select("img_id", "bin", F.explode(F.array(F.lit(0).cast("long"), F.col("quarter"))).alias("region")).groupBy("img_id", "region", "bin").agg(F.count(F.lit(1)).alias("n"))
    length = F.sqrt(F.sum(F.col("n").cast("double") ** 2).over(Window.partitionBy("img_id", "region")))
    return n.select("img_id", "region", "bin", (F.col("n") / length).alias("share"))


def dominant_color(px: DataFrame) -> DataFrame:
    return px.groupBy("img_id").agg(*[F.avg(c).alias(c) for c in ("b", "g", "r")])


def gaussian_histogram(px: DataFrame, bins: int = 8, sigma: float = 16.0) -> DataFrame:
    """(img_id, bin, share): gray values weigh each bin by a Gaussian of their distance to its centre."""
    w = 256 / bins
    near = with_colors(px).select("img_id", *[F.exp(-F.pow(F.col("gray") - (i + 0.5) * w, F.lit(2.0)) / (2 * sigma**2)).alias(f"w{i}") for i in range(bins)])
    s = near.groupBy("img_id").agg(*[F.sum(f"w{i}").alias(f"w{i}") for i in range(bins)])
    total = reduce(add, [F.col(f"w{i}") for i in range(bins)]) + TINY
    return s.select("img_id", F.posexplode(F.array(*[F.col(f"w{i}") / total for i in range(bins)])).alias("bin", "share"))


def joint_histogram(px: DataFrame, bins: int = 4) -> DataFrame:
    """(img_id, rb, gb, bb, share): hard bins of red, green, blue."""
    w = 256 // bins
    n = px.groupBy("img_id", *[F.floor(F.col(c) / w).alias(f"{c}b") for c in "rgb"]).agg(F.count(F.lit(1)).alias("n"))
    return n.select("img_id", "rb", "gb", "bb", (F.col("n") / F.sum("n").over(Window.partitionBy("img_id"))).alias("share"))


def cell_histograms(px: DataFrame, side: int = 16, bins: int = 8) -> DataFrame:
    """(img_id, cell, channel, bin, share, cdf): hard histograms of blue, green and red by cell."""
    c = channels(px).where("channel <> 'gray'").groupBy("img_id", _cell(side).alias("cell"), "channel", F.floor(F.col("value") / (256 / bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    part = Window.partitionBy("img_id", "cell", "channel")
    share = F.col("n") / F.sum("n").over(part)
    return c.withColumn("share", share).withColumn("cdf", F.sum("share").over(part.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).drop("n")
