"""Boxes, reading order and recogniser results."""

from __future__ import annotations


import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palmleaf.functions.text import strip

#: Schema of a recogniser's page: parallel lists, with three names for the boxes.
PAGE_SCHEMA = (
    "rec_texts array<string>, rec_scores array<double>, rec_polys array<array<array<double>>>, "
    "dt_polys array<array<array<double>>>, rec_boxes array<array<array<double>>>"
)
#: Schema of the older list form: [quadrilateral, [text, score]] a line.
LINES_SCHEMA = "array<struct<points:array<array<double>>,text:string,score:double>>"


def box(points: Column, pad: float = 0.18, height: Column | None = None) -> Column:
    """struct(x, y, w, h) around a polygon, padded upwards and downwards."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    x1, x2, y1, y2 = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    w = F.greatest(F.lit(0), (x2 - x1).cast("int"))
    h = F.greatest(F.lit(0), (y2 - y1).cast("int"))
    dy = (h * pad).cast("int")
    padded = (h > 0) & (F.lit(pad) > 0)
    top = F.when(padded, F.greatest(F.lit(0.0), y1 - dy)).otherwise(y1)
    end = y2 + dy
    low = F.when(height > 0, F.least(height.cast("double"), end)).otherwise(end) if height is not None else end
    tall = F.when(padded, (low - top).cast("int")).otherwise(h)
    return F.struct(x1.cast("int").alias("x"), top.cast("int").alias("y"), w.alias("w"), tall.alias("h"))


def segments(pages: DataFrame, page: str = "page", height: Column | None = None) -> DataFrame:
    """One row a segment with text, conf and box: the lists are zipped up to the
    shortest, blank texts go, ``seg_id`` keeps the order."""
    p = F.col(page)
    polys = F.coalesce(p["rec_polys"], p["dt_polys"], p["rec_boxes"])
    n = F.least(F.size(p["rec_texts"]), F.size(p["rec_scores"]), F.size(polys))
    zipped = F.slice(F.arrays_zip(p["rec_texts"].alias("t"), p["rec_scores"].alias("s"), polys.alias("b")), F.lit(1), F.greatest(n, F.lit(0)))
    rows = pages.select(*[c for c in pages.columns if c != page], F.posexplode(zipped).alias("seg_id", "z"))
    out = rows.withColumns({"text": strip(F.col("z.t")), "conf": F.col("z.s"), "box": box(F.col("z.b"), height=height)})
    return out.where("text <> ''").drop("z")


def columns_of(boxes: DataFrame, by: str = "doc_id", tolerance: float = 0.25) -> DataFrame:
    """``col_id``: the vertical band of a box."""
    widest = F.max(F.col("x") + F.col("w")).over(Window.partitionBy(by))
    return boxes.withColumn("col_id", F.floor(F.col("x") / F.greatest(F.lit(100.0), widest * tolerance)).cast("bigint"))


def _lines(tops: list[int], tall: list[int], tolerance: float) -> list[int]:
    """Line number of each box, greedily: the first line whose running mean centre
    is near enough; numbers in the order of the lines' tops."""
    if not tops:
        return []
    near = max(6, int(sum(tall) / len(tall) * tolerance))
    lines: list[list] = []  # [sum of centres, count, least top, members]
    for k in sorted(range(len(tops)), key=lambda i: tops[i]):
        centre = tops[k] + tall[k] / 2.0
        for line in lines:
            if abs(centre - line[0] / line[1]) <= near:
                line[0] += centre
                line[1] += 1
                line[2] = min(line[2], tops[k])
                line[3].append(k)
                break
        else:
            lines.append([centre, 1, tops[k], [k]])
    out = [0] * len(tops)
    for number, line in enumerate(sorted(lines, key=lambda x: x[2])):
        for k in line[3]:
            out[k] = number
    return out


def reading_order(boxes: DataFrame, by: str = "doc_id", seg: str = "seg_id", multi_column: bool = False, column_tol: float = 0.25, line_tol: float = 0.5) -> DataFrame:
    """by, seg, col_id, line_no and ``reading_pos`` of each box.

    Lines form by a fold in order of the tops, so a page is one group; a page's
    boxes are few, whatever the number of pages.
    """
    source = columns_of(boxes, by, column_tol) if multi_column else boxes.withColumn("col_id", F.lit(0).cast("bigint"))
    by_type, seg_type = boxes.schema[by].dataType.simpleString(), boxes.schema[seg].dataType.simpleString()

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by([("col_id", "ascending"), (seg, "ascending")])
        d = table.to_pydict()
        rows = []
        for col in sorted(set(d["col_id"])):
            at = [k for k, c in enumerate(d["col_id"]) if c == col]
            numbers = _lines([d["y"][k] for k in at], [d["h"][k] for k in at], line_tol)
            rows += [(col, n, d["x"][k], d["y"][k], k) for n, k in zip(numbers, at, strict=True)]
        rows.sort()
        return pa.table(
            {
                by: table.column(by).take([r[4] for r in rows]),
                seg: table.column(seg).take([r[4] for r in rows]),
                "col_id": pa.array([r[0] for r in rows], pa.int64()),
                "line_no": pa.array([r[1] for r in rows], pa.int64()),
                "reading_pos": pa.array(range(len(rows)), pa.int64()),
            }
        )

    return source.select(by, seg, "x", "y", "h", "col_id").groupBy(by).applyInArrow(
        fold, f"`{by}` {by_type}, `{seg}` {seg_type}, col_id bigint, line_no bigint, reading_pos bigint"
    )


def confidence_stats(segments_: DataFrame, by: list[str]) -> DataFrame:
    """Mean, least and largest confidence, count and characters a group."""
    return segments_.groupBy(*by).agg(
        F.coalesce(F.sum("conf") / F.count("conf"), F.lit(0.0)).alias("mean_conf"),
        F.coalesce(F.min("conf"), F.lit(0.0)).alias("min_conf"),
        F.coalesce(F.max("conf"), F.lit(0.0)).alias("max_conf"),
        F.count("*").alias("n_segments"),
        F.sum(F.length(strip(F.coalesce("text", F.lit(""))))).alias("n_text"),
    )


def needs_second_pass(n: Column, mean: Column, least: Column) -> Column:
    return (n == 0) | (mean < 0.88) | (least < 0.70)


def choose_pass(one: DataFrame, two: DataFrame, by: str) -> DataFrame:
    """``pass_selected`` 1 or 2 from the statistics of both passes."""
    a = one.select(by, *[F.col(c).alias(f"{c}_1") for c in ("n_segments", "mean_conf", "n_text")])
    b = two.select(by, *[F.col(c).alias(f"{c}_2") for c in ("n_segments", "mean_conf", "n_text")])
    n1, n2 = F.coalesce("n_segments_1", F.lit(0)), F.coalesce("n_segments_2", F.lit(0))
    better = (F.col("mean_conf_2") > F.col("mean_conf_1") + 0.03) & (F.col("n_text_2") >= F.floor(F.col("n_text_1") * 0.85))
    second = ((n1 == 0) & (n2 > 0)) | ((n1 > 0) & (n2 > 0) & better)
    return a.join(b, by, "full").withColumn("pass_selected", F.when(second, 2).otherwise(1))


def longer_text(one: Column, two: Column) -> Column:
    """The longer of two texts, the second on ties."""
    return F.when(F.length(strip(one)) > F.length(strip(two)), one).otherwise(two)


def crop_width(w: Column, h: Column) -> Column:
    """Width of a recogniser's input: 48 high, in steps of 16, 320 to 1024."""
    scaled = F.greatest(F.lit(32), (w * (48.0 / F.greatest(F.lit(1), h))).cast("int"))
    return F.greatest(F.lit(320), F.least(F.lit(1024), (F.floor((scaled + 15) / 16) * 16).cast("int")))


