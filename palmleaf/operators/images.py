"""Image operators on the pixel relation ``(img_id, y, x, v)``.

Sums, projections, histograms and morphology are aggregates and windows keyed by
image (and row or column), so images never leave the JVM and no task holds more
than a row or column of one image per window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grid(vectors: DataFrame, vec: str = "embedding", img_id: str = "vec_id", width: int = 8) -> DataFrame:
    """Vectors as small grey images."""
    k = F.col("k")
    v = F.floor((F.col("e").cast("double") + 0.5) * 255.0).cast("int")
    return vectors.select(F.col(img_id).alias("img_id"), F.posexplode(vec).alias("k", "e")).select(
        "img_id", F.floor(k / width).cast("int").alias("y"), (k % width).cast("int").alias("x"), F.greatest(F.lit(0), F.least(F.lit(255), v)).alias("v")
    )


def grey(r: Column, g: Column, b: Column) -> Column:
    """Luma of a colour pixel."""
    return F.bround(0.299 * r + 0.587 * g + 0.114 * b).cast("int")


def row_sums(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("img_id", "y").agg(F.sum("v").alias("proj"))


def column_sums(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("img_id", "x").agg(F.sum("v").alias("proj"))


def headline(pixels: DataFrame) -> DataFrame:
    """(img_id, h, headline_y): the strongest row of the upper half, the first on ties."""
    rows = row_sums(pixels)
    sized = rows.join(pixels.groupBy("img_id").agg((F.max("y") + 1).alias("h")), "img_id")
    upper = sized.where(F.col("y") < F.greatest(F.lit(1), F.floor(F.col("h") / 2)))
    return upper.groupBy("img_id").agg(F.first("h").alias("h"), F.max_by("y", F.struct("proj", -F.col("y"))).alias("headline_y"))


def zones(heads: DataFrame) -> DataFrame:
    """Three rows an image: zone, y0, y1 (end exclusive), from the headline."""
    h, y = F.col("h"), F.col("headline_y")
    end = F.least(y + F.greatest(F.lit(1), F.floor((h - y) * 0.65).cast("int")), h)
    third = (y <= 0) | (y >= h - 2)
    a, b = F.floor(h / 3).cast("int"), F.floor(2 * h / 3).cast("int")
    small = h < 6
    cut = lambda s, t, n: F.when(small, F.lit(s) if isinstance(s, int) else s).when(third, t).otherwise(n)
    upper, middle = cut(0, a, y), cut(h, b, end)
    rows = F.array(
        F.struct(F.lit("upper").alias("zone"), F.lit(0).alias("y0"), upper.alias("y1")),
        F.struct(F.lit("middle").alias("zone"), upper.alias("y0"), middle.alias("y1")),
        F.struct(F.lit("lower").alias("zone"), middle.alias("y0"), h.alias("y1")),
    )
    return heads.select("img_id", F.inline(rows))


def blank_headline(pixels: DataFrame, heads: DataFrame) -> DataFrame:
    """The headline's band set to white; row 0 leaves the image as it is."""
    band = F.greatest(F.lit(2), F.floor(F.col("h") * 0.03).cast("int"))
    near = (F.col("headline_y") > 0) & F.col("y").between(F.col("headline_y") - band, F.col("headline_y") + band)
    return pixels.join(heads, "img_id").select("img_id", "y", "x", F.when(near, 255).otherwise(F.col("v")).alias("v"))


def polarity(pixels: DataFrame, dark: float = 110.0) -> DataFrame:
    """Images that are dark on average are inverted."""
    mean = F.avg("v").over(Window.partitionBy("img_id"))
    return pixels.withColumn("v", F.when(mean < dark, 255 - F.col("v")).otherwise(F.col("v")))


def quadrant_spread(pixels: DataFrame) -> DataFrame:
    """Population deviation of the four quadrant means."""
    size = pixels.groupBy("img_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    quad = (F.col("y") >= F.floor(F.col("h") / 2)).cast("int") * 2 + (F.col("x") >= F.floor(F.col("w") / 2)).cast("int")
    means = pixels.join(size, "img_id").groupBy("img_id", quad.alias("q")).agg(F.avg("v").alias("m"))
    return means.groupBy("img_id").agg(F.stddev_pop("m").alias("spread"))


def otsu(pixels: DataFrame) -> DataFrame:
    """(img_id, threshold): the value with the largest between-class variance."""
    hist = pixels.groupBy("img_id", "v").agg(F.count("*").alias("n"))
    w = Window.partitionBy("img_id").orderBy("v")
    all_ = Window.partitionBy("img_id")
    s = hist.withColumns(
        {
            "n0": F.sum("n").over(w), "s0": F.sum(F.col("n") * F.col("v")).over(w),
            "n_all": F.sum("n").over(all_), "s_all": F.sum(F.col("n") * F.col("v")).over(all_),
        }
    ).where("n0 < n_all")
    n0, n1 = F.col("n0").cast("double"), (F.col("n_all") - F.col("n0")).cast("double")
    gap = F.col("s0") / n0 - (F.col("s_all") - F.col("s0")) / n1
    return s.withColumn("between", n0 * n1 * gap * gap).groupBy("img_id").agg(F.max_by("v", F.struct("between", -F.col("v"))).alias("threshold"))


def binarise(pixels: DataFrame, thresholds: DataFrame) -> DataFrame:
    return pixels.join(thresholds, "img_id", "left").select("img_id", "y", "x", F.when(F.col("v") > F.col("threshold"), 255).otherwise(0).alias("v"))


def _slide(pixels: DataFrame, how, along: str, reach: int) -> DataFrame:
    across = "y" if along == "x" else "x"
    w = Window.partitionBy("img_id", across).orderBy(along).rowsBetween(-reach, reach)
    return pixels.withColumn("v", how("v").over(w))


def dilate(pixels: DataFrame, kx: int = 3, ky: int = 1) -> DataFrame:
    """Largest value in a kx x ky window: rows, then columns."""
    return _slide(_slide(pixels, F.max, "x", kx // 2), F.max, "y", ky // 2) if ky > 1 else _slide(pixels, F.max, "x", kx // 2)


def erode(pixels: DataFrame, kx: int = 3, ky: int = 1) -> DataFrame:
    return _slide(_slide(pixels, F.min, "x", kx // 2), F.min, "y", ky // 2) if ky > 1 else _slide(pixels, F.min, "x", kx // 2)


def close_(pixels: DataFrame, kx: int = 3, ky: int = 1) -> DataFrame:
    return erode(dilate(pixels, kx, ky), kx, ky)


def open_(pixels: DataFrame, kx: int = 3, ky: int = 1) -> DataFrame:
    return dilate(erode(pixels, kx, ky), kx, ky)


def heal(pixels: DataFrame, kx: int = 3, ky: int = 1) -> DataFrame:
    """Bridges gaps of strokes: a closing of the ink, whichever is darker."""
    light = F.avg("v").over(Window.partitionBy("img_id")) > 127
    ink = pixels.withColumn("light", light).withColumn("v", F.when(F.col("light"), 255 - F.col("v")).otherwise(F.col("v")))
    return close_(ink, kx, ky).select("img_id", "y", "x", F.when(F.col("light"), 255 - F.col("v")).otherwise(F.col("v")).alias("v"))


def flat_field(pixels: DataFrame, kernel: int = 51) -> DataFrame:
    """Values over their closed background; the kernel is odd and fits the image."""
    k = kernel | 1
    ground = close_(pixels, k, k).select("img_id", "y", "x", F.col("v").alias("ground"))
    out = F.least(F.lit(255), F.bround(F.col("v") * 255.0 / F.greatest(F.col("ground"), F.lit(1))).cast("int"))
    return pixels.join(ground, ["img_id", "y", "x"]).select("img_id", "y", "x", out.alias("v"))


def local_sums(pixels: DataFrame, window: int) -> DataFrame:
    """n, s and q: count, sum and sum of squares in the window around a pixel, cut
    at the borders; rows first, then columns."""
    reach = window // 2
    row = Window.partitionBy("img_id", "y").orderBy("x").rowsBetween(-reach, reach)
    col = Window.partitionBy("img_id", "x").orderBy("y").rowsBetween(-reach, reach)
    v = F.col("v").cast("bigint")
    first = pixels.withColumns({"n": F.count("v").over(row), "s": F.sum(v).over(row), "q": F.sum(v * v).over(row)})
    return first.withColumns({"n": F.sum("n").over(col), "s": F.sum("s").over(col), "q": F.sum("q").over(col)})


def sauvola(pixels: DataFrame, window: int = 25, k: float = 0.2, r: float = 128.0) -> DataFrame:
    """White above the local threshold ``mean * (1 + k * (deviation / r - 1))``."""
    mean = F.col("s") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    return local_sums(pixels, window | 1).select(
        "img_id", "y", "x", F.when(F.col("v") > mean * (1 + k * (spread / r - 1)), 255).otherwise(0).alias("v")
    )


def border_means(pixels: DataFrame, ratio: float = 0.035, dark: int = 45) -> DataFrame:
    """Mean of each margin and of the inside, and which margins are dark."""
    size = pixels.groupBy("img_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    p = pixels.join(size, "img_id")
    mh, mw = F.greatest(F.lit(1), F.floor(F.col("h") * ratio)), F.greatest(F.lit(1), F.floor(F.col("w") * ratio))
    y, x, v = F.col("y"), F.col("x"), F.col("v")
    sides = {"top": y < mh, "bottom": y >= F.col("h") - mh, "left": x < mw, "right": x >= F.col("w") - mw}
    inner = ~(sides["top"] | sides["bottom"] | sides["left"] | sides["right"])
    mean = lambda c: F.sum(F.when(c, v)) / F.sum(F.when(c, 1))
    out = p.groupBy("img_id").agg(*[mean(c).alias(f"{k}_mean") for k, c in sides.items()], mean(inner).alias("inner_mean"))
    return out.withColumns({f"{k}_dark": F.coalesce(F.col(f"{k}_mean") < F.col("inner_mean") - dark, F.lit(False)) for k in sides})


def line_bands(rows: DataFrame, share: float = 0.15, floor: int = 5, least: int = 12) -> DataFrame:
    """(img_id, y0, y1) of runs of rows over the threshold that are tall enough; a
    run that reaches the last row is not a band."""
    w = Window.partitionBy("img_id")
    limit = F.greatest(F.lit(floor), F.floor(F.avg("proj").over(w) * share).cast("int"))
    flagged = rows.withColumns({"ink": F.col("proj") > limit, "last": F.max("y").over(w)})
    order = w.orderBy("y")
    island = flagged.withColumn("g", F.sum((~F.col("ink")).cast("int")).over(order)).where("ink")
    runs = island.groupBy("img_id", "g", "last").agg(F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"))
    return runs.where((F.col("y1") - 1 < F.col("last")) & (F.col("y1") - F.col("y0") >= least)).select("img_id", "y0", "y1")


def components(pixels: DataFrame, ink: Column | None = None) -> DataFrame:
    """(img_id, label, area, w, h, aspect) of 8-connected runs of ink, one image a
    group."""
    import pandas as pd

    marked = pixels.where(F.col("v") > 127 if ink is None else ink).select("img_id", "y", "x")

    def fill(table: pd.DataFrame) -> pd.DataFrame:
        left = set(zip(table.y, table.x, strict=True))
        rows = []
        for first in sorted(left):
            if first not in left:
                continue
            left.discard(first)
            todo, seen = [first], [first]
            while todo:
                y, x = todo.pop()
                for near in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                    if near in left:
                        left.discard(near)
                        todo.append(near)
                        seen.append(near)
            ys, xs = [p[0] for p in seen], [p[1] for p in seen]
            w, h = max(xs) - min(xs) + 1, max(ys) - min(ys) + 1
            rows.append((table.img_id.iloc[0], len(rows), len(seen), w, h, max(w / h, h / w)))
        return pd.DataFrame(rows, columns=["img_id", "label", "area", "w", "h", "aspect"])

    kind = pixels.schema["img_id"].dataType.simpleString()
    return marked.groupBy("img_id").applyInPandas(fill, f"img_id {kind}, label bigint, area bigint, w bigint, h bigint, aspect double")


def trim_bounds(pixels: DataFrame, ink: int = 2, pad: int = 4) -> DataFrame:
    """(img_id, x0, x1): columns with ink, padded."""
    sums = column_sums(pixels)
    return sums.groupBy("img_id").agg(
        F.greatest(F.lit(0), F.min(F.when(F.col("proj") > ink, F.col("x"))) - pad).alias("x0"),
        F.least(F.max("x") + 1, F.max(F.when(F.col("proj") > ink, F.col("x"))) + pad).alias("x1"),
    )
