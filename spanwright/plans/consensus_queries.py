"""Registration by consensus, on draws that both engines make.

A sheet shows 240 places: mirrored, 18 points a foot, jittered, every seventh missing, every
eleventh elsewhere. Every fourth try draws true pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.operators import consensus as N
from spanwright.sources.scratch import large

from .registrar import query
from .views import PRELUDE, places

TRIES = 40
_j = lambda a, b: f"((n * {a}) % 41 - 20) * 0.25"
MODEL = {"n": "n", "sheet": "n // 240", "mark": "mark", "x": "px", "y": "py"}
DRAWN = {"n": "n", "sheet": "n // 240", "mark": "mark", "x": f"100 + 18 * py + {_j(7919, 1)} + CASE WHEN n % 11 = 0 THEN 400.0 ELSE 0.0 END", "y": f"50 + 18 * px + {_j(6277, 1)}"}
A = "(h * 37 + r * 101 + h * h % 29) % 240"
B = f"(({A}) + CASE WHEN h % 4 = 0 OR (h % 4 = 1 AND r < 2) THEN 0 ELSE 4 * (1 + (h + r * 7) % 50) END) % 240"

FITS = """
{0}m AS (SELECT sheet, h, reflected, avg(sx) AS mx, avg(sy) AS my, avg(dx) AS mu, avg(dy) AS mv, count(*) AS n FROM {1} GROUP BY ALL),
{0}z AS (
  SELECT sheet, h, reflected, n, mx, my, mu, mv, sum((sx - mx) * (dx - mu) + (sy - my) * (dy - mv)) / nullif(sum((sx - mx) ** 2 + (sy - my) ** 2), 0) AS p,
    sum((sx - mx) * (dy - mv) - (sy - my) * (dx - mu)) / nullif(sum((sx - mx) ** 2 + (sy - my) ** 2), 0) AS q
  FROM {1} JOIN {0}m USING (sheet, h, reflected) GROUP BY ALL),
{0} AS (SELECT sheet, h, reflected, n, p, q, mu - (p * mx - q * my) AS e, mv - (q * mx + p * my) AS f FROM {0}z WHERE p IS NOT NULL)"""
#: Marks of a sheet stand 80 ft apart, scales are one and more: no point has two partners.
NEAR = """
SELECT t.sheet, t.h, t.reflected, m.x AS sx, CASE WHEN t.reflected THEN -m.y ELSE m.y END AS sy, d.x AS dx, d.y AS dy
FROM {0} t JOIN model m ON m.sheet = t.sheet JOIN drawn d ON d.sheet = t.sheet AND d.mark = m.mark
WHERE sqrt((t.p * m.x - t.q * (CASE WHEN t.reflected THEN -m.y ELSE m.y END) + t.e - d.x) ** 2 + (t.q * m.x + t.p * (CASE WHEN t.reflected THEN -m.y ELSE m.y END) + t.f - d.y) ** 2) <= 16"""


def _sql(columns: dict[str, str], where: str) -> str:
    return f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM places WHERE {where}"


@query(
    PRELUDE + f""", model AS ({_sql(MODEL, "true")}), drawn AS ({_sql(DRAWN, "n % 7 <> 0")}),
tries AS (SELECT sheet, h, r, sheet * 240 + {A} AS a, sheet * 240 + {B} AS b FROM (SELECT DISTINCT sheet FROM model), (SELECT unnest(range({TRIES})) AS h), (SELECT unnest(range(3)) AS r)),
pairs AS (SELECT t.sheet, t.h, t.r, m.x AS sx, m.y AS sy, d.x AS dx, d.y AS dy FROM tries t JOIN model m ON m.n = t.a JOIN drawn d ON d.n = t.b),
good AS (SELECT sheet, h FROM pairs GROUP BY ALL HAVING count(*) = 3 AND (var_pop(sx) * var_pop(sy) - covar_pop(sx, sy) ** 2) / nullif((var_pop(sx) + var_pop(sy)) ** 2, 0) >= 1e-6),
variants AS (SELECT sheet, h, false AS reflected, sx, sy, dx, dy FROM pairs JOIN good USING (sheet, h) UNION ALL SELECT sheet, h, true, sx, -sy, dx, dy FROM pairs JOIN good USING (sheet, h)),
{FITS.format("f1", "variants")},
in1 AS ({NEAR.format("(SELECT * FROM f1 WHERE sqrt(p * p + q * q) BETWEEN 1 AND 200)")}),
enough AS (SELECT * FROM in1 WHERE (sheet, h, reflected) IN (SELECT (sheet, h, reflected) FROM in1 GROUP BY sheet, h, reflected HAVING count(*) >= 3)),
{FITS.format("f2", "enough")},
res AS (SELECT f.sheet, f.h, f.reflected, sqrt(avg((p * sx - q * sy + e - dx) ** 2 + (q * sx + p * sy + f - dy) ** 2)) AS rms FROM f2 f JOIN enough i USING (sheet, h, reflected) GROUP BY ALL),
in2 AS (SELECT sheet, h, reflected, count(*) AS inliers FROM ({NEAR.format("f2")}) GROUP BY ALL)
SELECT sheet, CAST(h AS BIGINT) AS h, reflected, inliers, round(rms, 4) AS rms, round(sqrt(p * p + q * q), 4) AS scale FROM f2 JOIN res USING (sheet, h, reflected) JOIN in2 USING (sheet, h, reflected)
QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY inliers DESC, round(rms, 9), h, reflected) = 1"""
)
def ransac_fit(spark: SparkSession, d: str) -> DataFrame:
    """The best of forty tries on every sheet, refitted to its inliers."""
    rows = lambda cols, where: places(spark, d).where(where).selectExpr(*[f"{e.replace('//', 'div')} AS {c}" for c, e in cols.items()]).selectExpr("n", "sheet", "mark", "cast(x AS double) AS x", "cast(y AS double) AS y")
    model, drawn = rows(MODEL, "true"), rows(DRAWN, "n % 7 <> 0")
    tries = model.select("sheet").distinct().withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(TRIES - 1)))).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(2))))
    tries = tries.selectExpr("sheet", "h", "r", f"sheet * 240 + {A} AS a", f"sheet * 240 + {B} AS b")
    draws = large(tries).join(large(model.selectExpr("n AS a", "x AS sx", "y AS sy")), "a").join(large(drawn.selectExpr("n AS b", "x AS dx", "y AS dy")), "b").withColumnRenamed("sheet", "by")
    best = N.best_fits(draws, model, drawn, "sheet", "mark", 16.0)
    return best.select("sheet", "h", "reflected", "inliers", F.round("rms", 4).alias("rms"), F.round("scale", 4).alias("scale"))
