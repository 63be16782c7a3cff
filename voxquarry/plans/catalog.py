"""The registered queries: every operator over the whole derived views, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import aggregate as A
from ..operators import blocks as B
from ..operators import metrics as M
from ..operators import patches as P
from ..operators import points as Q
from ..operators import tasks as T
from ..operators import voxels as V
from . import views
from .views import EXTENT, table, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
XYZ = ("z", "y", "x")
BOXES = ("z0", "y0", "x0", "z1", "y1", "x1")


def query(sql: str | None = None, view_names: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = with_views(view_names, sql) if view_names else sql
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# flagship


@query(
    """
SELECT z // 2 AS bz, y // 4 AS by, x // 4 AS bx, count(*) AS n, round(avg(value), 6) AS mean FROM (
  SELECT z // 2 AS z, y // 2 AS y, x // 2 AS x, avg(CASE WHEN value > 40 THEN 1.0 ELSE 0.0 END) AS value FROM vox
  WHERE z >= 0 AND z < 8 AND y >= 4 AND y < 28 AND x >= 4 AND x < 28 GROUP BY 1, 2, 3) GROUP BY 1, 2, 3""",
    "vox",
)
def volume_pipeline(spark, d):
    """Cutout, threshold, 2 x 2 x 2 average, and count and mean of each block of the result."""
    cut = V.cutout(views.vox(spark, d), (0, 4, 4), (8, 28, 28))
    small = A.downsample(V.mapped(cut, V.threshold(F.col("value"), 40)), (2, 2, 2))
    blocks = [G.floor_div(a, n).alias(f"b{a}") for a, n in zip(XYZ, (2, 4, 4))]
    return rounded(small.groupBy(*blocks).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")), "mean")


# maps


def voxel_map(name: str, sql: str, column) -> None:
    @query(f"SELECT z, y, x, {sql} AS value FROM vox", "vox")
    def run(spark, d):
        return V.mapped(views.vox(spark, d), column(F.col("value")))

    QUERIES[name] = QUERIES.pop("run")
    ORACLE[name] = ORACLE.pop("run")


voxel_map("threshold", "CAST(value > 40 AS BIGINT)", lambda v: V.threshold(v, 40))
voxel_map("normalize_intensity", "round(value / 127.5::DOUBLE - 1, 6)", lambda v: F.round(V.normalize_intensity(v), 6))
voxel_map("inverse", "255 - value", V.inverse)
voxel_map("mapto01", "round(value / 255::DOUBLE, 6)", lambda v: F.round(V.map_to_01(v), 6))
voxel_map("stretch_intensity", "CAST(floor(least(greatest((value - 20) / 100::DOUBLE, 0), 1) * 255) AS BIGINT)", lambda v: V.stretch(v, 20, 120))
voxel_map("rescale_intensity", "round((least(greatest(value::DOUBLE, 10), 200) - 10) / 190::DOUBLE * 255, 6)", lambda v: F.round(V.rescale(v, 10, 200), 6))
voxel_map("window_level", "round((value - 60) / 80::DOUBLE, 6)", lambda v: F.round(V.window_level(v, 40, 100), 6))
voxel_map("adjust_gamma", "round(pow(value / 255::DOUBLE, 0.5), 6)", lambda v: F.round(V.adjust_gamma(v / 255, 0.5), 6))
voxel_map("save_convert", "round(value / 255::DOUBLE, 6)", lambda v: F.round(V.saved(v, "uint8", "float32"), 6))
voxel_map("astype", "CAST(trunc((value - 100) / 7::DOUBLE) AS BIGINT)", lambda v: V.astype((v - 100) / 7, "int64"))


@query("SELECT x AS z, y, z AS x, value FROM vox", "vox")
def transpose(spark, d):
    return V.transpose(views.vox(spark, d))


@query("SELECT a.z, a.y, a.x, a.value * b.value AS value FROM vox a JOIN lab b USING (z, y, x)", "vox lab")
def multiply(spark, d):
    return V.multiply(views.vox(spark, d), views.lab(spark, d))


@query("SELECT z, y, x, CAST(floor(sum(value) / 2 * 255) AS BIGINT) AS value FROM prob WHERE c < 2 GROUP BY z, y, x", "prob")
def quantize_affinity_xy(spark, d):
    return V.quantize_affinity(views.prob(spark, d))


@query("SELECT z, y, x, CAST(floor(value * 255) AS BIGINT) AS value FROM prob WHERE c = 2", "prob")
def quantize_affinity_z(spark, d):
    return V.quantize_affinity(views.prob(spark, d), use="z")


@query("SELECT a.i AS z, b.i AS y, c.i AS x, CAST(floor(abs(sin(4 * (a.i / 7::DOUBLE + b.i / 31::DOUBLE + c.i / 31::DOUBLE))) * 255) AS BIGINT) AS value FROM (SELECT unnest(range(8)) AS i) a, (SELECT unnest(range(32)) AS i) b, (SELECT unnest(range(32)) AS i) c")
def create_chunk(spark, d):
    return V.create(spark, EXTENT)


@query("SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST((i - 1) // 16 AS BIGINT) AS z, CAST((i - 1) // 4 % 4 AS BIGINT) AS y, CAST((i - 1) % 4 AS BIGINT) AS x, round(CAST(embedding[i] AS DOUBLE), 6) AS value FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)")
def embedding_voxels(spark, d):
    """Each embedding as a 4 x 4 x 4 block, voxel by voxel."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("long"), F.posexplode("embedding").alias("i", "value"))
    return e.select("vec_id", F.floor(F.col("i") / 16).alias("z"), F.floor(F.col("i") / 4 % 4).alias("y"), (F.col("i") % 4).cast("long").alias("x"), F.round(F.col("value").cast("double"), 6).alias("value"))


# filters


@query("SELECT * FROM vox WHERE z >= 1 AND z < 7 AND y >= 5 AND y < 30 AND x >= 3 AND x < 20", "vox")
def cutout(spark, d):
    return V.cutout(views.vox(spark, d), (1, 5, 3), (7, 30, 20))


@query("SELECT * FROM vox WHERE z >= 1 AND z < 7 AND y >= 2 AND y < 30 AND x >= 3 AND x < 29", "vox")
def crop_margin(spark, d):
    return V.crop_margin(views.vox(spark, d), ((0, 0, 0), EXTENT), (1, 2, 3))


@query("SELECT z, y, x, CASE WHEN z IN (2, 5) THEN 0 ELSE value END AS value FROM vox", "vox")
def blackout_sections(spark, d):
    return V.blackout(views.vox(spark, d), [2, 5])


@query("SELECT z, y, x FROM vox WHERE value > 100", "vox")
def where(spark, d):
    return V.where(V.mapped(views.vox(spark, d), V.threshold(F.col("value"), 100)))


@query("SELECT z // 2 AS tz, y // 2 AS ty, x // 2 AS tx FROM vox GROUP BY 1, 2, 3 HAVING bool_or(value > 60)", "vox")
def skip_all_zero(spark, d):
    df = V.mapped(views.vox(spark, d), V.threshold(F.col("value"), 60))
    return V.not_all_zero(df.withColumns({f"t{a}": G.floor_div(a, 2) for a in XYZ}), ["tz", "ty", "tx"])


@query("SELECT z, y, x, CASE WHEN value IN (SELECT value FROM lab WHERE value <> 0 GROUP BY value HAVING count(*) > 50) AND value IN (1, 2, 3, 5) THEN value ELSE 0 END AS value FROM lab", "lab")
def mask_out_objects(spark, d):
    return V.mask_out_objects(views.lab(spark, d), dust=50, keep=[1, 2, 3, 5])


@query("SELECT vox.z, vox.y, vox.x, CASE WHEN m.value = 1 THEN vox.value ELSE 0 END AS value FROM vox JOIN coarse m ON vox.z // 2 = m.z AND vox.y // 4 = m.y AND vox.x // 4 = m.x", "vox coarse")
def mask(spark, d):
    return V.mask(views.vox(spark, d), views.coarse(spark, d), (2, 4, 4))


@query("SELECT vox.z, vox.y, vox.x, CASE WHEN m.value = 0 THEN vox.value ELSE 0 END AS value FROM vox JOIN coarse m ON vox.z // 2 = m.z AND vox.y // 4 = m.y AND vox.x // 4 = m.x", "vox coarse")
def mask_inverse(spark, d):
    return V.mask(views.vox(spark, d), views.coarse(spark, d), (2, 4, 4), inverse=True)


@query("SELECT DISTINCT z * 2 // 4 AS bz, y * 4 // 8 AS by, x * 4 // 8 AS bx FROM coarse WHERE value <> 0", "coarse")
def candidate_blocks(spark, d):
    return V.candidate_blocks(views.coarse(spark, d), (2, 4, 4), (4, 8, 8))


@query("SELECT z, y, x, CAST(value * (1 + CAST(y >= 16 AS BIGINT)) AS BIGINT) AS value FROM vox", "vox")
def blend(spark, d):
    v = views.vox(spark, d)
    return V.blend(v.unionByName(V.cutout(v, (0, 16, 0), EXTENT)))


@query("SELECT z, y, x, CASE WHEN y < 8 THEN 255 - value ELSE value END AS value FROM vox", "vox")
def save_into(spark, d):
    v = views.vox(spark, d)
    return V.save_into(v, V.mapped(V.cutout(v, (0, 0, 0), (8, 8, 32)), V.inverse(F.col("value"))))


# aggregations


@query("SELECT z // 2 AS z, y // 2 AS y, x // 2 AS x, round(avg(value), 6) AS value FROM vox GROUP BY 1, 2, 3", "vox")
def downsample_average(spark, d):
    return rounded(A.downsample(views.vox(spark, d), (2, 2, 2)), "value")


@query("SELECT z // 1 AS z, y // 3 AS y, x // 3 AS x, max(value) AS value FROM vox GROUP BY 1, 2, 3", "vox")
def downsample_max(spark, d):
    return A.downsample(views.vox(spark, d), (1, 3, 3), "max")


@query("SELECT z // 2 AS z, y // 2 AS y, x // 2 AS x, value FROM vox WHERE z % 2 = 0 AND y % 2 = 0 AND x % 2 = 0", "vox")
def downsample_stride(spark, d):
    return A.downsample(views.vox(spark, d), (2, 2, 2), "stride")


@query("SELECT z, y, x, value FROM (SELECT z // 2 AS z, y // 2 AS y, x // 2 AS x, value, row_number() OVER (PARTITION BY z // 2, y // 2, x // 2 ORDER BY count(*) DESC, value) AS r FROM lab GROUP BY z // 2, y // 2, x // 2, value) WHERE r = 1", "lab")
def downsample_mode(spark, d):
    return A.downsample(views.lab(spark, d), (2, 2, 2), "mode")


@query(
    """SELECT z, y, x, CASE WHEN a = b OR a = c THEN a WHEN b = c THEN b ELSE d END AS value FROM (
  SELECT z, y // 2 AS y, x // 2 AS x, max(CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN value END) AS a, max(CASE WHEN y % 2 = 0 AND x % 2 = 1 THEN value END) AS b,
    max(CASE WHEN y % 2 = 1 AND x % 2 = 0 THEN value END) AS c, max(CASE WHEN y % 2 = 1 AND x % 2 = 1 THEN value END) AS d FROM lab GROUP BY z, y // 2, x // 2)""",
    "lab",
)
def downsample_countless(spark, d):
    return A.countless(views.lab(spark, d))


@query(
    """SELECT z, y, x, coalesce(nullif(CASE WHEN a = b OR a = c THEN a WHEN b = c THEN b ELSE 0 END, 0), nullif(d, 0), nullif(a, 0), nullif(b, 0), c) AS value FROM (
  SELECT z, y // 2 AS y, x // 2 AS x, max(CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN value END) AS a, max(CASE WHEN y % 2 = 0 AND x % 2 = 1 THEN value END) AS b,
    max(CASE WHEN y % 2 = 1 AND x % 2 = 0 THEN value END) AS c, max(CASE WHEN y % 2 = 1 AND x % 2 = 1 THEN value END) AS d FROM lab GROUP BY z, y // 2, x // 2)""",
    "lab",
)
def downsample_stippled(spark, d):
    return A.stippled(views.lab(spark, d))


def _countless_sql(source: str) -> str:
    """Of the eight samples p: the first that at least four equal, else three, else two of the first seven, else the last."""
    at = [f"max(value) FILTER (z % 2 = {i // 4} AND y % 2 = {i // 2 % 2} AND x % 2 = {i % 2})" for i in range(8)]
    alike = "len(list_filter({among}, lambda w: w = v)) >= {n}"
    picks = [f"list_filter(p, lambda v: {alike.format(among='p', n=n)})[1]" for n in (4, 3)] + [f"list_filter(p[1:7], lambda v: {alike.format(among='p[1:7]', n=2)})[1]"]
    return f"SELECT z, y, x, coalesce({', '.join(picks)}, p[8]) AS value FROM (SELECT z // 2 AS z, y // 2 AS y, x // 2 AS x, [{', '.join(at)}] AS p FROM {source} GROUP BY z // 2, y // 2, x // 2)"


@query(f", l1 AS ({_countless_sql('lab')}) SELECT 1::BIGINT AS mip, * FROM l1 UNION ALL SELECT 2::BIGINT, * FROM ({_countless_sql('l1')})", "lab")
def downsample_countless_3d(spark, d):
    one = A.countless_3d(views.lab(spark, d))
    two = A.countless_3d(one)
    return one.select(F.lit(1).cast("long").alias("mip"), *XYZ, "value").unionByName(two.select(F.lit(2).cast("long").alias("mip"), *XYZ, "value"))


@query(
    """, l1 AS (SELECT z, y // 2 AS y, x // 2 AS x, avg(value) AS value FROM vox GROUP BY 1, 2, 3), l2 AS (SELECT z, y // 2 AS y, x // 2 AS x, avg(value) AS value FROM l1 GROUP BY 1, 2, 3)
SELECT CAST(1 AS BIGINT) AS mip, z, y, x, round(value, 6) AS value FROM l1 UNION ALL SELECT 2, z, y, x, round(value, 6) FROM l2""",
    "vox",
)
def downsample_pyramid(spark, d):
    levels = A.pyramid(views.vox(spark, d), (1, 2, 2), 2)
    one, two = (rounded(v, "value").select(F.lit(i + 1).cast("long").alias("mip"), *XYZ, "value") for i, v in enumerate(levels[1:]))
    return one.unionByName(two)


@query("SELECT z, y, x, c + 1 AS value FROM (SELECT *, row_number() OVER (PARTITION BY z, y, x ORDER BY value DESC, c) AS r FROM prob) WHERE r = 1", "prob")
def channel_voting(spark, d):
    return A.channel_voting(views.prob(spark, d))


@query("SELECT p.c, p.z, p.y, p.x, round(CASE WHEN l.value < 0.1 THEN p.value ELSE 0 END, 6) AS value FROM prob p JOIN prob l USING (z, y, x) WHERE l.c = 2 AND p.c < 2", "prob")
def mask_using_last_channel(spark, d):
    return rounded(A.mask_using_last_channel(views.prob(spark, d), 0.1), "value")


@query("SELECT value, count(*) AS n FROM lab WHERE value <> 0 GROUP BY value", "lab")
def unique_labels(spark, d):
    return A.label_sizes(views.lab(spark, d))


@query("SELECT count(*) AS n, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, count(DISTINCT value) AS n_values, CAST(count(*) FILTER (value <> 0) AS BIGINT) AS n_nonzero FROM lab", "lab")
def statistics(spark, d):
    return rounded(A.statistics(views.lab(spark, d)), "mean")


@query("SELECT value, n, r AS rank FROM (SELECT value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, value) - 1 AS r FROM lab WHERE value > (SELECT min(value) FROM lab) GROUP BY value) WHERE r >= 1 AND r < 4", "lab")
def ranked_labels(spark, d):
    return A.ranked_labels(views.lab(spark, d), 1, 4)


# contrast

_CONTRAST = """,
k AS (SELECT s.k AS g, b.i AS v, coalesce(q.n, 0) AS n FROM (SELECT unnest(range(256)) AS i) b CROSS JOIN (SELECT DISTINCT {g} AS k FROM vox) s LEFT JOIN (SELECT {g} AS g, value, count(*) AS n FROM vox WHERE value <> 0 GROUP BY 1, 2) q ON q.g = s.k AND q.value = b.i),
c AS (SELECT g, v, sum(n) OVER (PARTITION BY g ORDER BY v) / (sum(n) OVER (PARTITION BY g))::DOUBLE AS p FROM k),
e AS (SELECT g, coalesce(max(v) FILTER (p <= 0.01), 0) AS lo, coalesce(max(v) FILTER (p <= 0.99), 0) AS hi FROM c GROUP BY g)
SELECT z, y, x, CASE WHEN lo = hi THEN value ELSE CAST(round_even(least(greatest((value - lo) * 255::DOUBLE / (hi - lo), 1), 255), 0) AS BIGINT) END AS value FROM vox JOIN e ON {g} = e.g"""


@query(_CONTRAST.format(g="vox.z"), "vox")
def normalize_contrast(spark, d):
    return A.normalize_contrast(views.vox(spark, d))


@query(_CONTRAST.format(g="(vox.z * 0)"), "vox")
def normalize_contrast_whole(spark, d):
    return A.normalize_contrast(views.vox(spark, d), per_section=False)


@query(
    """, s AS (SELECT z, min(value) AS a, max(value) AS b FROM vox GROUP BY z),
i AS (SELECT z, min(value) AS lo, max(value) AS hi FROM vox JOIN s USING (z) WHERE value <> a AND value <> b GROUP BY z)
SELECT z, y, x, round(CASE WHEN lo IS NULL OR lo = hi THEN value ELSE least(greatest((value - lo) / (hi - lo)::DOUBLE * 255, 0), 255) END, 6) AS value FROM vox LEFT JOIN i USING (z)""",
    "vox",
)
def normalize_section_shang(spark, d):
    return rounded(A.normalize_section_shang(views.vox(spark, d)), "value")


@query(
    """, c AS (SELECT value AS v, sum(count(*)) OVER (ORDER BY value) / (sum(count(*)) OVER ())::DOUBLE AS p FROM vox GROUP BY value),
e AS (SELECT min(v) FILTER (p >= 0.01) AS lo, min(v) FILTER (p >= 0.99) AS hi FROM c)
SELECT z, y, x, CASE WHEN lo = hi THEN value ELSE CAST(floor(least(greatest((value - lo) * 255::DOUBLE / (hi - lo), 0), 255)) AS BIGINT) END AS value FROM vox, e""",
    "vox",
)
def clip_percentile(spark, d):
    return A.clip_percentile(views.vox(spark, d))


# segmentation metrics


def tab(spark, d):
    return M.contingency(views.pairs(spark, d))


@query("SELECT * FROM tab", "tab")
def contingency(spark, d):
    return tab(spark, d)


_PAIRS = """, q AS (SELECT sum(n)::DOUBLE AS n, sum(n * n)::DOUBLE AS s FROM tab), r AS (SELECT sum(m * m)::DOUBLE AS r FROM (SELECT sum(n) AS m FROM tab GROUP BY seg)), k AS (SELECT sum(m * m)::DOUBLE AS k FROM (SELECT sum(n) AS m FROM tab GROUP BY gt)),
p AS (SELECT (s - n) / 2 AS a, (r - s) / 2 AS b, (k - s) / 2 AS c, (s + n * n - r - k) / 2 AS d, n, s, r, k FROM q, r, k)
"""


@query(_PAIRS + "SELECT a, b, c, d FROM p", "tab")
def pair_counts(spark, d):
    return M.pair_counts(tab(spark, d))


_VI = """, rows_ AS (SELECT seg, sum(n) AS m FROM tab0 GROUP BY seg), cols AS (SELECT gt, sum(n) AS m FROM tab0 GROUP BY gt), t AS (SELECT sum(n)::DOUBLE AS t FROM tab0)
"""


@query(
    _PAIRS.rstrip() + _VI + """SELECT round((a + d) / (a + b + c + d), 9) AS rand_index, round(2 * (a * d - b * c) / ((a + b) * (b + d) + (a + c) * (c + d)), 9) AS adjusted_rand_index, round(a / sqrt((a + b) * (a + c)), 9) AS fowlkes_mallows,
  round((SELECT -sum(tab0.n / t.t * log2(tab0.n / m::DOUBLE)) FROM tab0 JOIN rows_ USING (seg), t), 9) AS false_merge, round((SELECT -sum(tab0.n / t.t * log2(tab0.n / m::DOUBLE)) FROM tab0 JOIN cols USING (gt), t), 9) AS false_split,
  CAST((SELECT coalesce(sum(m), 0) FROM (SELECT count(*) - 1 AS m FROM tab0 WHERE n > 100 GROUP BY seg)) AS BIGINT) AS edit_merges, CAST((SELECT coalesce(sum(m), 0) FROM (SELECT count(*) - 1 AS m FROM tab0 WHERE n > 100 GROUP BY gt)) AS BIGINT) AS edit_splits FROM p""",
    "tab0",
)
def evaluate_segmentation(spark, d):
    return rounded(M.evaluate(tab(spark, d), 100).drop("vi"), "rand_index", "adjusted_rand_index", "fowlkes_mallows", "false_merge", "false_split", digits=9)


@query(_VI + "SELECT seg AS label, round(m / t.t, 9) AS p, round(-sum(n / m::DOUBLE * log2(n / m::DOUBLE)), 9) AS h, round(m / t.t * -sum(n / m::DOUBLE * log2(n / m::DOUBLE)), 9) AS ph FROM tab0 JOIN rows_ USING (seg), t GROUP BY seg, m, t.t", "tab0")
def sorted_vi_components(spark, d):
    return rounded(M.sorted_vi_components(tab(spark, d), "seg"), "p", "h", "ph", digits=9)


@query(
    """, own AS (SELECT gt AS label, n FROM tab WHERE seg = 3), sizes AS (SELECT gt AS label, sum(n) AS size FROM tab GROUP BY gt)
SELECT label, round(n / (SELECT sum(n) FROM own), 9) AS overlap, round(n / size, 9) AS "of" FROM own JOIN sizes USING (label) ORDER BY overlap DESC, label LIMIT 3""",
    "tab",
)
def split_components(spark, d):
    return rounded(M.split_components(tab(spark, d), 3, 3), "overlap", "of", digits=9)


def _vi_sql(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS a, '{b}' AS b, round(-sum(n / t * (log2(n / ra) + log2(n / rb))), 9) AS vi FROM (
  SELECT n, sum(n) OVER (PARTITION BY p)::DOUBLE AS ra, sum(n) OVER (PARTITION BY q)::DOUBLE AS rb, sum(n) OVER ()::DOUBLE AS t FROM (SELECT {a} AS p, {b} AS q, count(*) AS n FROM three WHERE {a} <> 0 AND {b} <> 0 GROUP BY 1, 2))"""


@query(", three AS (SELECT seg, gt, (seg + gt) % 3 AS mix FROM pairs) " + " UNION ALL ".join(_vi_sql(*x) for x in (("seg", "gt"), ("seg", "mix"), ("gt", "mix"))), "pairs")
def vi_pairwise(spark, d):
    return rounded(M.vi_pairwise(views.pairs(spark, d).withColumn("mix", (F.col("seg") + F.col("gt")) % 3), ["seg", "gt", "mix"]), "vi", digits=9)


@query(_VI + ", c AS (SELECT m / t.t * -sum(n / m::DOUBLE * log2(n / m::DOUBLE)) AS ph FROM tab0 JOIN rows_ USING (seg), t GROUP BY seg, m, t.t) SELECT round(avg(ph), 9) AS mean, round(median(ph), 9) AS median, round(max(ph), 9) AS most, round(stddev_samp(ph) / sqrt(count(ph)), 9) AS sem FROM c", "tab0")
def vi_statistics(spark, d):
    return rounded(M.vi_statistics(tab(spark, d), "seg"), "mean", "median", "most", "sem", digits=9)


@query(_PAIRS + "SELECT round(1 - 2 * ((s - n) / (r - n)) * ((s - n) / (k - n)) / ((s - n) / (r - n) + (s - n) / (k - n)), 9) AS error, round((s - n) / (r - n), 9) AS precision, round((s - n) / (k - n), 9) AS recall FROM p", "tab")
def adapted_rand_error(spark, d):
    return rounded(M.adapted_rand_error(tab(spark, d)), "error", "precision", "recall", digits=9)


@query("""SELECT CAST((SELECT coalesce(sum(m), 0) FROM (SELECT count(*) - 1 AS m FROM tab WHERE n > 100 AND seg <> 0 AND gt <> 0 GROUP BY seg)) AS BIGINT) AS false_merges,
  CAST((SELECT coalesce(sum(m), 0) FROM (SELECT count(*) - 1 AS m FROM tab WHERE n > 100 AND seg <> 0 AND gt <> 0 GROUP BY gt)) AS BIGINT) AS false_splits""", "tab")
def edit_distance(spark, d):
    return M.edit_distance(tab(spark, d), 100)


@query("SELECT round(count(*) FILTER (value > 40 AND y % 2 = 0) / (count(*) FILTER (value > 40))::DOUBLE, 9) AS precision, round(count(*) FILTER (value > 40 AND y % 2 = 0) / (count(*) FILTER (y % 2 = 0))::DOUBLE, 9) AS recall FROM vox", "vox")
def boundary_precision_recall(spark, d):
    return rounded(M.boundary_precision_recall(views.vox(spark, d), F.col("value") > 40, F.col("y") % 2 == 0), "precision", "recall", digits=9)


@query(
    """, ball AS (SELECT a.r AS dz, b.r AS dy, c.r AS dx FROM range(-2, 3) a(r), range(-2, 3) b(r), range(-2, 3) c(r) WHERE abs(a.r) + abs(b.r) + abs(c.r) <= 2),
grown AS (SELECT z + dz AS z, y + dy AS y, x + dx AS x, max(value) AS wide, max((y % 8 = 0)::INT) AS near FROM vox, ball GROUP BY 1, 2, 3),
met AS (SELECT z, y, x, value, wide, near, (y % 8 = 0)::INT AS t, row_number() OVER (PARTITION BY value ORDER BY z, y, x) AS k FROM vox JOIN grown USING (z, y, x)),
own AS (SELECT value, near, t, CASE WHEN k = 1 AND value NOT IN (SELECT wide FROM met) THEN value ELSE wide END AS wide FROM met)
SELECT threshold::BIGINT AS threshold, round((SELECT sum(near) FROM own WHERE value >= threshold) / (SELECT count(*) FROM own WHERE value >= threshold)::DOUBLE, 9) AS precision,
  round((SELECT sum(t) FROM own WHERE wide >= threshold) / (SELECT sum(t) FROM own)::DOUBLE, 9) AS recall FROM (SELECT DISTINCT value AS threshold FROM own)""",
    "vox",
)
def wiggle_room_precision_recall(spark, d):
    out = M.wiggle_room_precision_recall(views.vox(spark, d), F.col("value"), F.col("y") % 8 == 0, (4, 16, 16))
    return rounded(out, "precision", "recall", digits=9)


@query("SELECT seg, gt, n FROM (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY n DESC, gt) AS r FROM tab) WHERE r = 1", "tab")
def assignment_table(spark, d):
    return M.assignment_table(tab(spark, d))


@query("SELECT seg // 2 * 2 AS seg, gt, CAST(sum(n) AS BIGINT) AS n FROM tab GROUP BY 1, 2", "tab")
def merge_contingency_table(spark, d):
    t = tab(spark, d)
    return M.merged(t, t.select("seg").distinct().withColumn("target", F.floor(F.col("seg") / 2) * 2))


# tasks


@query("SELECT CAST(a.i * 9 + b.i * 3 + c.i AS BIGINT) AS task_id, a.i * 4 AS z0, b.i * 12 AS y0, c.i * 12 AS x0, a.i * 4 + 4 AS z1, b.i * 12 + 16 AS y1, c.i * 12 + 16 AS x1, concat(a.i * 4, '-', a.i * 4 + 4, '_', b.i * 12, '-', b.i * 12 + 16, '_', c.i * 12, '-', c.i * 12 + 16) AS bbox FROM (SELECT unnest(range(2)) AS i) a, (SELECT unnest(range(3)) AS i) b, (SELECT unnest(range(3)) AS i) c")
def generate_tasks(spark, d):
    return T.generate(spark, (0, 0, 0), (8, 36, 36), (4, 16, 16), overlap=(0, 4, 4))


def boxes(spark, d):
    """A box for each order."""
    o = table(spark, d, "orders")
    z, y, x = F.col("o_orderkey") % 50 - 20, F.col("o_custkey") % 70 - 30, F.col("o_orderkey") % 31
    return o.select(F.col("o_orderkey").alias("task_id"), z.alias("z0"), y.alias("y0"), x.alias("x0"), (z + 5).alias("z1"), (y + 9).alias("y1"), (x + 4).alias("x1"))


_BOXES = "b AS (SELECT o_orderkey AS task_id, o_orderkey % 50 - 20 AS z0, o_custkey % 70 - 30 AS y0, o_orderkey % 31 AS x0, o_orderkey % 50 - 15 AS z1, o_custkey % 70 - 21 AS y1, o_orderkey % 31 + 4 AS x1 FROM orders)"
_NAME = "concat(z0, '-', z1, '_', y0, '-', y1, '_', x0, '-', x1)"


@query(f"WITH {_BOXES} SELECT *, {_NAME} AS bbox FROM b")
def bbox_text(spark, d):
    """Boxes written as text and read back."""
    named = boxes(spark, d).withColumn("bbox", G.format_box()).select("task_id", "bbox")
    return G.parse_box(named, F.concat(F.lit("run_"), "bbox", F.lit(".h5"))).select("task_id", *BOXES, "bbox")


@query(f"WITH {_BOXES} SELECT task_id, z0 - 1 AS z0, y0 - 2 AS y0, x0 - 3 AS x0, z1 + 4 AS z1, y1 + 5 AS y1, x1 + 6 AS x1 FROM b")
def adjust_bbox(spark, d):
    return G.adjust(boxes(spark, d), (-1, -2, -3), (4, 5, 6))


@query(
    f"""WITH {_BOXES} SELECT task_id, 'z' AS axis, z0 - 5 AS z0, y0, x0, z0 AS z1, y1, x1 FROM b
UNION ALL SELECT task_id, 'y', z0, y0 - 9, x0, z1, y0, x1 FROM b UNION ALL SELECT task_id, 'x', z0, y0, x0 - 4, z1, y1, x0 FROM b"""
)
def left_neighbors(spark, d):
    return G.left_neighbors(boxes(spark, d)).select("task_id", "axis", *BOXES)


@query(f"WITH {_BOXES} SELECT task_id, least(z0, 0) AS z0, least(y0, 0) AS y0, least(x0, 0) AS x0, greatest(z1, 10) AS z1, greatest(y1, 10) AS y1, greatest(x1, 10) AS x1 FROM b")
def bbox_union(spark, d):
    df = boxes(spark, d).withColumnsRenamed({n: f"a{n}" for n in BOXES}).withColumns({f"b{n}": F.lit(v).cast("long") for n, v in zip(BOXES, (0, 0, 0, 10, 10, 10))})
    return df.select("task_id", *G.union_box("a", "b"))


@query(f"WITH {_BOXES} SELECT task_id, greatest(z0, 0) AS z0, greatest(y0, 0) AS y0, greatest(x0, 0) AS x0, least(z1, 10) AS z1, least(y1, 10) AS y1, least(x1, 10) AS x1 FROM b")
def bbox_intersection(spark, d):
    df = boxes(spark, d).withColumnsRenamed({n: f"a{n}" for n in BOXES}).withColumns({f"b{n}": F.lit(v).cast("long") for n, v in zip(BOXES, (0, 0, 0, 10, 10, 10))})
    return df.select("task_id", *G.intersection_box("a", "b"))


@query(f"WITH {_BOXES} SELECT task_id, " + ", ".join(f"CAST(floor({n} / {f}::DOUBLE) AS BIGINT) AS {n}" for n, f in zip(BOXES, (2, 4, 4, 2, 4, 4))) + " FROM b")
def bbox_rescale(spark, d):
    return boxes(spark, d).select("task_id", *G.rescaled((2, 4, 4), coarser=True))


def _blocks_sql(first: str, last: str, stop: str) -> str:
    axis = lambda a, n: f"unnest(generate_series({first.format(a=a, n=n)}, {last.format(a=a, n=n)}, {n})) AS {a}"
    out = f"WITH {_BOXES}, z_ AS (SELECT *, {axis('z', 2)} FROM b), y_ AS (SELECT *, {axis('y', 4)} FROM z_), x_ AS (SELECT *, {axis('x', 3)} FROM y_) "
    return out + "SELECT task_id, CAST(z AS BIGINT) AS z0, CAST(y AS BIGINT) AS y0, CAST(x AS BIGINT) AS x0, " + ", ".join(f"CAST({stop.format(a=a, n=n)} AS BIGINT) AS {a}1" for a, n in (("z", 2), ("y", 4), ("x", 3))) + " FROM x_"


@query(_blocks_sql("{a}0", "{a}1 - {n}", "{a} + {n}"))
def decompose_full(spark, d):
    return G.decompose(boxes(spark, d), (2, 4, 3), mode="full")


@query(_blocks_sql("CAST(floor({a}0 / {n}::DOUBLE) AS BIGINT) * {n}", "{a}1 - 1", "{a} + {n}"))
def decompose_aligned(spark, d):
    return G.decompose(boxes(spark, d), (2, 4, 3), mode="aligned")


@query(_blocks_sql("{a}0", "{a}1 - 1", "least({a} + {n}, {a}1)"))
def decompose_clamped(spark, d):
    return G.decompose(boxes(spark, d), (2, 4, 3), mode="clamped")


@query(f"WITH {_BOXES} SELECT * FROM b WHERE task_id // 10 = 7")
def fetch_task(spark, d):
    return T.fetch(boxes(spark, d), 7, 10)


def _files(spark, d):
    """Marker files of every third order, every sixth of them empty."""
    named = boxes(spark, d).withColumn("bbox", G.format_box()).filter("task_id % 3 = 0")
    return named.select(F.concat(F.lit("/out/t_"), "bbox", F.lit(".h5")).alias("path"), F.when(F.col("task_id") % 6 == 0, 0).otherwise(9).alias("length"))


_FILE = f"WITH {_BOXES}, f AS (SELECT DISTINCT {_NAME} AS n FROM b WHERE task_id % 3 = 0), g AS (SELECT DISTINCT {_NAME} AS n FROM b WHERE task_id % 3 = 0 AND task_id % 6 <> 0) "


@query(_FILE + f"SELECT task_id FROM b WHERE {_NAME} NOT IN (SELECT n FROM f)")
def skip_task_by_file(spark, d):
    return T.skip_by_file(boxes(spark, d).withColumn("bbox", G.format_box()), _files(spark, d), prefix="t_", suffix=".h5").select("task_id")


@query(_FILE + f"SELECT task_id FROM b WHERE {_NAME} IN (SELECT n FROM g)")
def skip_task_by_empty_file(spark, d):
    return T.skip_by_file(boxes(spark, d).withColumn("bbox", G.format_box()), _files(spark, d), prefix="t_", suffix=".h5", mode="empty").select("task_id")


@query(_blocks_sql("CAST(floor({a}0 / {n}::DOUBLE) AS BIGINT) * {n}", "{a}1 - 1", "{a} + {n}").replace("SELECT task_id, CAST(z", "SELECT DISTINCT task_id FROM (SELECT task_id, CAST(z").replace(" FROM x_", " FROM x_) WHERE (CAST(floor(z0 / 2.0) AS BIGINT) + CAST(floor(y0 / 4.0) AS BIGINT) + CAST(floor(x0 / 3.0) AS BIGINT)) % 11 = 0"))
def skip_task_by_blocks(spark, d):
    """Stored are the blocks whose numbers' sum is no multiple of 11."""
    stored = G.decompose(boxes(spark, d), (2, 4, 3), mode="aligned").select(*[G.floor_div(f"{a}0", n).alias(f"b{a}") for a, n in zip(XYZ, (2, 4, 3))]).filter("(bz + by + bx) % 11 <> 0")
    return T.skip_by_blocks(boxes(spark, d), stored, (2, 4, 3)).select("task_id")


@query("SELECT doc_id FROM documents WHERE lang IS NOT NULL")
def skip_none(spark, d):
    return T.skip_none(table(spark, d, "documents"), "lang").select("doc_id")


@query("SELECT compute_device, operator, round(avg(seconds), 6) AS mean, round(max(seconds), 6) AS max, round(min(seconds), 6) AS min, round(sum(seconds), 4) AS sum, count(seconds) AS n FROM op_log GROUP BY 1, 2", "op_log")
def log_summary(spark, d):
    return rounded(rounded(T.log_summary(views.op_log(spark, d)), "mean", "max", "min"), "sum", digits=4)


@query("SELECT compute_device, round(1e6 * count(*) / sum(s) / 1e3, 6) AS kvoxels_per_s FROM (SELECT compute_device, task_id, sum(seconds) AS s FROM op_log GROUP BY 1, 2) GROUP BY 1", "op_log")
def log_speed(spark, d):
    return rounded(T.speed(views.op_log(spark, d), 1_000_000), "kvoxels_per_s")


# points


@query("SELECT pre_idx, coalesce(n, 0) AS n FROM pre LEFT JOIN (SELECT pre_idx, count(*) AS n FROM post GROUP BY 1) USING (pre_idx)", "pre post")
def posts_per_pre(spark, d):
    return Q.posts_per_pre(views.pre(spark, d), views.post(spark, d))


_DIST = "sqrt(pow(post.z - pre.z, 2) + pow(post.y - pre.y, 2) + pow(post.x - pre.x, 2))"


@query(f"SELECT post_idx, pre_idx, round({_DIST}, 6) AS distance FROM post JOIN pre USING (pre_idx)", "pre post")
def distances_from_pre_to_post(spark, d):
    return rounded(Q.distances(views.pre(spark, d), views.post(spark, d)), "distance")


@query("SELECT min(z) AS z0, min(y) AS y0, min(x) AS x0, max(z) + 1 AS z1, max(y) + 1 AS y1, max(x) + 1 AS x1 FROM (SELECT z, y, x FROM pre UNION ALL SELECT z, y, x FROM post)", "pre post")
def synapse_bounding_box(spark, d):
    return Q.bounding_box(views.pre(spark, d).select(*XYZ).unionByName(views.post(spark, d).select(*XYZ)))


@query("SELECT post_idx, pre_idx FROM post WHERE pre_idx IN (SELECT pre_idx FROM pre WHERE z BETWEEN 10 AND 60 AND y BETWEEN 5 AND 80 AND x BETWEEN 0 AND 70)", "pre post")
def remove_synapses_outside_box(spark, d):
    return Q.cascade(Q.inside_box(views.pre(spark, d), (10, 5, 0), (60, 80, 70)), views.post(spark, d)).select("post_idx", "pre_idx")


@query("SELECT pre_idx, z, y, x, NULL::DOUBLE AS conf FROM pre UNION ALL SELECT p_partkey + 1 + (SELECT max(pre_idx) FROM pre), p_partkey % 7, p_partkey % 11, p_size, 0.5::DOUBLE FROM part", "pre")
def add_pre(spark, d):
    """A point for each part beside the pres of the orders."""
    more = table(spark, d, "part").select(F.col("p_partkey").alias("pre_idx"), (F.col("p_partkey") % 7).alias("z"), (F.col("p_partkey") % 11).alias("y"), F.col("p_size").cast("long").alias("x"))
    return Q.add_pre(views.pre(spark, d).drop("user"), more, 0.5)


@query("SELECT pre_idx FROM pre WHERE pre_idx NOT IN (SELECT pre_idx FROM post)", "pre post")
def pre_without_post(spark, d):
    return Q.without_post(views.pre(spark, d), views.post(spark, d)).select("pre_idx")


@query(", k AS (SELECT pre_idx, row_number() OVER (ORDER BY pre_idx) - 1 AS i FROM pre WHERE pre_idx IN (SELECT pre_idx FROM post)) SELECT post_idx, i AS pre_idx FROM post JOIN k USING (pre_idx)", "pre post")
def remove_synapses_without_post(spark, d):
    """What stays is counted from 0."""
    post = views.post(spark, d)
    return Q.reindexed(Q.having_post(views.pre(spark, d), post), post)[1].select("post_idx", "pre_idx")


@query("SELECT pre_idx FROM pre WHERE \"user\" = '1-URGENT'", "pre")
def points_of_user(spark, d):
    return Q.of_user(views.pre(spark, d), "1-URGENT").select("pre_idx")


@query(f"SELECT post_idx FROM (SELECT post_idx, {_DIST} AS d, row_number() OVER (PARTITION BY pre_idx ORDER BY {_DIST} / conf, post_idx) AS r FROM post JOIN pre USING (pre_idx)) WHERE d > 60 OR r > 2", "pre post")
def redundant_posts(spark, d):
    return Q.redundant_posts(views.pre(spark, d), views.post(spark, d), 60, 2)


@query("SELECT a.pre_idx AS a, b.pre_idx AS b, round(sqrt(pow(a.z - b.z, 2) + pow(a.y - b.y, 2) + pow(a.x - b.x, 2)), 6) AS distance FROM pre a JOIN pre b ON a.pre_idx < b.pre_idx AND abs(a.z - b.z) <= 3 AND abs(a.y - b.y) <= 3 AND abs(a.x - b.x) <= 3 WHERE pow(a.z - b.z, 2) + pow(a.y - b.y, 2) + pow(a.x - b.x, 2) <= 9", "pre")
def close_pairs(spark, d):
    return Q.pairs_of(rounded(Q.close_lists(views.pre(spark, d), 3, "pre_idx"), "distance"))


@query(
    f""", o AS (SELECT post_idx, post.z, post.y, post.x, {_DIST} AS d, lab.value AS o FROM post JOIN pre USING (pre_idx) JOIN lab ON post.z = lab.z AND post.y = lab.y AND post.x = lab.x WHERE lab.value <> 0)
SELECT DISTINCT CASE WHEN a.d > b.d THEN a.post_idx ELSE b.post_idx END AS post_idx FROM o a JOIN o b ON a.post_idx < b.post_idx AND a.o = b.o WHERE pow(a.z - b.z, 2) + pow(a.y - b.y, 2) + pow(a.x - b.x, 2) <= 1""",
    "pre post lab",
)
def duplicate_posts(spark, d):
    return Q.duplicate_posts_on_object(views.pre(spark, d), views.post(spark, d), F.broadcast(views.lab(spark, d)), 1)  # 8 x 32 x 32 labels, whatever the tables


@query("SELECT post_idx, lab.value AS label FROM post LEFT JOIN lab ON post.z = lab.z AND post.y = lab.y AND post.x = lab.x", "post lab")
def objects_under_points(spark, d):
    return V.points_in_objects(views.post(spark, d), views.lab(spark, d)).select("post_idx", "label")


@query("SELECT pre_idx, z * 40 AS z, y * 4 AS y, x * 4 AS x FROM pre", "pre")
def physical_coordinates(spark, d):
    return Q.physical(views.pre(spark, d), (40, 4, 4)).select("pre_idx", *XYZ)


@query("SELECT z, y, x, min(pre_idx) AS pre_idx FROM pre GROUP BY z, y, x", "pre")
def remove_pre_duplicates(spark, d):
    return Q.without_duplicates(views.pre(spark, d))


@query("SELECT o AS object_id, string_agg(n, ';' ORDER BY n) AS fragments FROM (SELECT l_orderkey % 50 AS o, concat(l_orderkey % 50, ':0:', l_partkey % 9, '-', l_suppkey % 9) AS n FROM lineitem) GROUP BY o")
def mesh_manifest(spark, d):
    names = table(spark, d, "lineitem").select(F.concat((F.col("l_orderkey") % 50).cast("string"), F.lit(":0:"), (F.col("l_partkey") % 9).cast("string"), F.lit("-"), (F.col("l_suppkey") % 9).cast("string")).alias("name"))
    return Q.group_fragments(names).select("object_id", F.array_join("fragments", ";").alias("fragments"))


# kernels


@query("SELECT z, y, x, round(value::DOUBLE, 6) AS value FROM vox", "vox")
def infer_identity(spark, d):
    """Overlapping patches through the identity, blended: the volume itself."""
    return rounded(P.infer(views.vox(spark, d), EXTENT, (4, 16, 16), (2, 4, 4)).drop("c"), "value")


@query("SELECT z, y, x, CAST(list_sort([coalesce(lag(value) OVER w, value), value, coalesce(lead(value) OVER w, value)])[2] AS BIGINT) AS value FROM vox WINDOW w AS (PARTITION BY y, x ORDER BY z)", "vox")
def median_filter(spark, d):
    return B.median_z(views.vox(spark, d))


def _gauss_sql() -> str:
    w = B.gaussian_weights(1.0)
    rows = ", ".join(f"({i - len(w) // 2}, {v!r}::DOUBLE)" for i, v in enumerate(w.tolist()))
    fold = lambda a: f"CASE WHEN {a} < 0 THEN -1 - ({a}) WHEN {a} > 31 THEN 63 - ({a}) ELSE {a} END"
    return f""", w(o, w) AS (VALUES {rows}),
h AS (SELECT v.z, v.y, v.x, sum(w.w * n.value) AS value FROM vox v CROSS JOIN w JOIN vox n ON n.z = v.z AND n.x = v.x AND n.y = {fold("v.y + w.o")} GROUP BY 1, 2, 3)
SELECT v.z, v.y, v.x, round(sum(w.w * n.value), 4) AS value FROM h v CROSS JOIN w JOIN h n ON n.z = v.z AND n.y = v.y AND n.x = {fold("v.x + w.o")} GROUP BY 1, 2, 3"""


@query(_gauss_sql(), "vox")
def gaussian_filter(spark, d):
    return rounded(B.gaussian_filter(views.vox(spark, d), 1.0), "value", digits=4)


@query(
    """, m AS (SELECT z, y, x, greatest(value - (SELECT avg(value) FROM vox), 0) AS v FROM vox), t AS (SELECT z, y, x, v / (SELECT max(v) FROM m) AS v FROM m)
SELECT a.z, a.y, a.x, round(a.v, 6) AS value FROM t a JOIN t b ON b.z BETWEEN a.z - 1 AND a.z + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1
WHERE a.v > 0.2 AND a.z BETWEEN 1 AND 6 AND a.y BETWEEN 1 AND 30 AND a.x BETWEEN 1 AND 30 GROUP BY a.z, a.y, a.x, a.v HAVING a.v = max(b.v)""",
    "vox",
)
def detect_points(spark, d):
    return rounded(B.detect_points(views.vox(spark, d), EXTENT, (4, 16, 16), threshold=0.2), "value")


@query(
    """, f AS (SELECT z * 1024 + y * 32 + x AS p, z, y, x FROM vox WHERE value > 200), e AS (SELECT a.p, b.p AS q FROM f a JOIN f b ON abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) = 1),
r AS (SELECT p AS root, p FROM f UNION SELECT r.root, e.q AS p FROM r JOIN e ON r.p = e.p), l AS (SELECT p, min(root) + 1 AS m FROM r GROUP BY p)
SELECT z, y, x, CAST(coalesce(m, 0) AS BIGINT) AS value FROM vox LEFT JOIN l ON p = z * 1024 + y * 32 + x""",
    "vox",
)
def connected_components(spark, d):
    df = V.mapped(views.vox(spark, d), V.threshold(F.col("value"), 200))
    return B.connected_components(df, EXTENT, (4, 16, 16))


@query()
def fill_segmentation_holes(spark, d):
    return B.fill_holes(V.mapped(views.vox(spark, d), V.threshold(F.col("value"), 20)), EXTENT, (4, 16, 16))


@query("SELECT true AS valid")
def validate(spark, d):
    """An image without a black box."""
    return B.validate(views.vox(spark, d), (8, 16, 16))


@query("SELECT z, y, x, value::DOUBLE AS value FROM vox", "vox")
def block_round_trip(spark, d):
    """Voxels to block payloads and back."""
    return B.to_voxels(B.to_blocks(views.vox(spark, d), (4, 16, 16)))
