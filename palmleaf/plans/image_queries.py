"""Queries of image operators on the grids of the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from palmleaf.operators import images
from palmleaf.plans.tables import table

QUERIES, ORACLE_SQL = {}, {}

_GRID = """g AS (
  SELECT vec_id AS img_id, CAST(floor(k / 8) AS INTEGER) AS y, CAST(k % 8 AS INTEGER) AS x,
         greatest(0, least(255, CAST(floor((CAST(e AS DOUBLE) + 0.5::DOUBLE) * 255.0::DOUBLE) AS INTEGER))) AS v
  FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS k, unnest(embedding) AS e FROM embeddings))"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"WITH {_GRID}, {sql}" if sql.lstrip().startswith(("_", "r ", "m ", "h ", "s ", "d ", "b ", "p ", "c ")) else f"WITH {_GRID} {sql}"
        return f

    return add


def _grid(spark, sf_dir):
    return images.grid(table(spark, sf_dir, "embeddings"))


@query(
    """r AS (SELECT img_id, y, sum(v) AS proj FROM g GROUP BY img_id, y)
    SELECT img_id, CAST(8 AS INTEGER) AS h, arg_max(y, (proj, -y)) AS headline_y FROM r WHERE y < 4 GROUP BY img_id"""
)
def img_projection(spark, sf_dir):
    """The strongest row of the upper half."""
    return images.headline(_grid(spark, sf_dir))


@query("SELECT img_id, x, sum(v) AS proj FROM g GROUP BY img_id, x")
def img_columns(spark, sf_dir):
    return images.column_sums(_grid(spark, sf_dir))


@query(
    """m AS (SELECT *, sum(v) OVER (PARTITION BY img_id) / 64.0::DOUBLE AS mean FROM g),
    q AS (SELECT img_id, (CASE WHEN y >= 4 THEN 2 ELSE 0 END) + (CASE WHEN x >= 4 THEN 1 ELSE 0 END) AS q, sum(v) AS s FROM g GROUP BY 1, 2),
    w AS (SELECT img_id, sum(s) AS t, sum(s * s) AS u FROM q GROUP BY img_id)
    SELECT m.img_id, sum(CASE WHEN mean < 110 THEN 255 - v ELSE v END) AS total, any_value(4 * u - t * t) AS spread4 FROM m JOIN w ON m.img_id = w.img_id GROUP BY m.img_id"""
)
def img_polarity(spark, sf_dir):
    """Sums after inversion of dark images, and the quadrants' spread in integers."""
    g = _grid(spark, sf_dir)
    total = images.polarity(g).groupBy("img_id").agg(F.sum("v").alias("total"))
    # the deviation of the means of four 16-pixel quadrants, without division
    spread = images.quadrant_spread(g).select("img_id", F.round(F.col("spread") * F.col("spread") * 16 * 256).cast("bigint").alias("spread4"))
    return total.join(spread, "img_id")


_OTSU = """h AS (SELECT img_id, v, count(*) AS n FROM g GROUP BY img_id, v),
    c AS (SELECT *, CAST(sum(n) OVER w AS DOUBLE) AS n0, CAST(sum(n * v) OVER w AS DOUBLE) AS s0, CAST(sum(n * v) OVER (PARTITION BY img_id) AS DOUBLE) AS sa FROM h
      WINDOW w AS (PARTITION BY img_id ORDER BY v)),
    t AS (SELECT img_id, v, n0 * (64 - n0) * (s0 / n0 - (sa - s0) / (64 - n0)) * (s0 / n0 - (sa - s0) / (64 - n0)) AS b FROM c WHERE n0 < 64),
    o AS (SELECT img_id, arg_max(v, (b, -v)) AS threshold FROM t GROUP BY img_id)"""


@query(f"""{_OTSU} SELECT g.img_id, any_value(threshold) AS threshold, count(*) FILTER (WHERE v > threshold) AS n_white FROM g JOIN o ON g.img_id = o.img_id GROUP BY g.img_id""")
def img_otsu(spark, sf_dir):
    """Global thresholds and the white pixels above them."""
    g = _grid(spark, sf_dir)
    t = images.otsu(g)
    white = images.binarise(g, t).groupBy("img_id").agg(F.sum((F.col("v") == 255).cast("bigint")).alias("n_white"))
    return t.join(white, "img_id")


def _slide(name: str, source: str, how: str, along: str, reach: int) -> str:
    across = "y" if along == "x" else "x"
    return f"{name} AS (SELECT img_id, y, x, {how}(v) OVER (PARTITION BY img_id, {across} ORDER BY {along} ROWS BETWEEN {reach} PRECEDING AND {reach} FOLLOWING) AS v FROM {source})"


@query(
    f"""m AS (SELECT img_id, y, x, sum(v) OVER (PARTITION BY img_id) > 127 * 64 AS light, v FROM g),
    i AS (SELECT img_id, y, x, light, CASE WHEN light THEN 255 - v ELSE v END AS v FROM m), {_slide('a', 'i', 'max', 'x', 1)}, {_slide('b', 'a', 'min', 'x', 1)}
    SELECT img_id, y, x, CASE WHEN light THEN 255 - b.v ELSE b.v END AS v FROM b JOIN (SELECT DISTINCT img_id, light FROM m) USING (img_id)"""
)
def img_close_1d(spark, sf_dir):
    """Gaps of strokes bridged along rows."""
    return images.heal(_grid(spark, sf_dir))


_CLOSE2 = ", ".join([_slide("r1", "g", "max", "x", 1), _slide("r2", "r1", "max", "y", 1), _slide("r3", "r2", "min", "x", 1), _slide("r4", "r3", "min", "y", 1)])


@query(
    f"""_n AS (SELECT 1), {_CLOSE2}
    SELECT g.img_id, g.y, g.x, CAST(least(255, round_even(g.v * 255.0::DOUBLE / greatest(r4.v, 1), 0)) AS INTEGER) AS v
    FROM g JOIN r4 ON g.img_id = r4.img_id AND g.y = r4.y AND g.x = r4.x"""
)
def img_close_2d(spark, sf_dir):
    """Values over their closed background."""
    return images.flat_field(_grid(spark, sf_dir), 3)


_ROW = "OVER (PARTITION BY img_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"
_COL = "OVER (PARTITION BY img_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"


@query(
    f"""r AS (SELECT *, count(v) {_ROW} AS n1, sum(v) {_ROW} AS s1, sum(v * v) {_ROW} AS q1 FROM g),
    k AS (SELECT img_id, y, x, v, CAST(sum(n1) {_COL} AS DOUBLE) AS n, CAST(sum(s1) {_COL} AS DOUBLE) AS s, CAST(sum(q1) {_COL} AS DOUBLE) AS q FROM r)
    SELECT img_id, y, x, CASE WHEN v > s / n * (1 + 0.2::DOUBLE * (sqrt(greatest(q / n - s / n * (s / n), 0.0::DOUBLE)) / 128.0::DOUBLE - 1)) THEN 255 ELSE 0 END AS v FROM k"""
)
def img_sauvola(spark, sf_dir):
    """Local thresholds from means and deviations around a pixel."""
    return images.sauvola(_grid(spark, sf_dir), 3)


@query(
    """b AS (SELECT img_id, sum(v) FILTER (WHERE y < 1) AS t, sum(v) FILTER (WHERE y >= 7) AS u, sum(v) FILTER (WHERE x < 1) AS l, sum(v) FILTER (WHERE x >= 7) AS r,
      sum(v) FILTER (WHERE y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6) AS i FROM g GROUP BY img_id)
    SELECT img_id, t / 8.0::DOUBLE AS top_mean, u / 8.0::DOUBLE AS bottom_mean, l / 8.0::DOUBLE AS left_mean, r / 8.0::DOUBLE AS right_mean, i / 36.0::DOUBLE AS inner_mean,
      t / 8.0::DOUBLE < i / 36.0::DOUBLE - 45 AS top_dark, u / 8.0::DOUBLE < i / 36.0::DOUBLE - 45 AS bottom_dark,
      l / 8.0::DOUBLE < i / 36.0::DOUBLE - 45 AS left_dark, r / 8.0::DOUBLE < i / 36.0::DOUBLE - 45 AS right_dark FROM b"""
)
def img_borders(spark, sf_dir):
    """Margin means and dark margins."""
    return images.border_means(_grid(spark, sf_dir))


@query(
    """r AS (SELECT img_id, y, sum(CASE WHEN v > 140 THEN 1 ELSE 0 END) AS proj FROM g GROUP BY img_id, y),
    f AS (SELECT *, proj > greatest(1, CAST(floor(sum(proj) OVER (PARTITION BY img_id) / 8.0::DOUBLE * 0.9::DOUBLE) AS INTEGER)) AS ink FROM r),
    i AS (SELECT *, sum(CASE WHEN ink THEN 0 ELSE 1 END) OVER (PARTITION BY img_id ORDER BY y) AS isl FROM f)
    SELECT img_id, min(y) AS y0, max(y) + 1 AS y1 FROM i WHERE ink GROUP BY img_id, isl HAVING max(y) < 7 AND max(y) + 1 - min(y) >= 2"""
)
def img_line_bands(spark, sf_dir):
    """Runs of inked rows."""
    rows = _grid(spark, sf_dir).groupBy("img_id", "y").agg(F.sum((F.col("v") > 140).cast("bigint")).alias("proj"))
    return images.line_bands(rows, share=0.9, floor=1, least=2)


@query(
    """r AS (SELECT img_id, y, sum(v) AS proj FROM g GROUP BY img_id, y),
    t AS (SELECT img_id, arg_max(y, (proj, -y)) AS y FROM r WHERE y < 4 GROUP BY img_id),
    e AS (SELECT img_id, y, least(8, y + greatest(1, CAST(floor((8 - y) * 0.65::DOUBLE) AS INTEGER))) AS m FROM t)
    SELECT img_id, zone, CAST(y0 AS INTEGER) AS y0, CAST(y1 AS INTEGER) AS y1 FROM (
      SELECT img_id, 'upper' AS zone, 0 AS y0, CASE WHEN y <= 0 THEN 2 ELSE y END AS y1 FROM e
      UNION ALL SELECT img_id, 'middle', CASE WHEN y <= 0 THEN 2 ELSE y END, CASE WHEN y <= 0 THEN 5 ELSE m END FROM e
      UNION ALL SELECT img_id, 'lower', CASE WHEN y <= 0 THEN 5 ELSE m END, 8 FROM e)"""
)
def img_zones(spark, sf_dir):
    """Upper, middle and lower zone around the headline."""
    return images.zones(images.headline(_grid(spark, sf_dir)))


@query(
    """SELECT img_id, row_number() OVER (PARTITION BY img_id ORDER BY first) - 1 AS label, area, w, h, greatest(w / h, h / w) AS aspect FROM (
      WITH RECURSIVE i AS (SELECT img_id, y, x, y * 8 + x AS cell FROM g WHERE v > 140),
      reach(img_id, cell, other) AS (
        SELECT img_id, cell, cell FROM i
        UNION SELECT r.img_id, r.cell, b.cell FROM reach r JOIN i a ON a.img_id = r.img_id AND a.cell = r.other
          JOIN i b ON b.img_id = a.img_id AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1),
      named AS (SELECT img_id, other AS cell, min(cell) AS first FROM reach GROUP BY img_id, other)
      SELECT img_id, first, count(*) AS area, CAST(max(cell % 8) - min(cell % 8) + 1 AS BIGINT) AS w, CAST(max(cell // 8) - min(cell // 8) + 1 AS BIGINT) AS h
      FROM named GROUP BY img_id, first)"""
)
def img_components(spark, sf_dir):
    """8-connected runs of bright pixels."""
    return images.components(_grid(spark, sf_dir), F.col("v") > 140)
