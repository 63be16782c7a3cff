"""Volumes, labelings and point relations derived from the relational tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.voxels import grid

EXTENT = (8, 32, 32)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place() -> list:
    return [F.pmod("l_partkey", F.lit(8)).alias("z"), F.pmod("l_suppkey", F.lit(32)).alias("y"), F.pmod("l_orderkey", F.lit(32)).alias("x")]


def vox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense 8 by 32 by 32 uint8 image; every row of lineitem adds to its voxel, and values spread over 0 to 250 whatever the number of rows."""
    cells = table(spark, sf_dir, "lineitem").groupBy(*_place()).agg(F.pmod(F.sum(F.floor(F.col("l_quantity") * 5)), F.lit(251)).alias("v"))
    return grid(spark, (0, 0, 0), EXTENT).join(cells, ["z", "y", "x"], "left").select("z", "y", "x", F.coalesce("v", F.lit(0)).cast("long").alias("value"))


def lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense segmentation: vox in steps of 20."""
    return vox(spark, sf_dir).withColumn("value", F.floor(F.col("value") / 20))


def prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three channels of values from 0 to 1."""
    cells = table(spark, sf_dir, "lineitem").groupBy(*_place()).agg(F.min(F.col("l_discount") * 10).alias("v0"), F.min(F.col("l_tax") * 12).alias("v1"), F.min(F.col("l_quantity") / 50).alias("v2"))
    return cells.select("z", "y", "x", F.posexplode(F.array("v0", "v1", "v2")).alias("c", "value")).select(F.col("c").cast("long"), "z", "y", "x", "value")


def coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mask in voxels (2, 4, 4) times as large: 1 where the mean of vox is above 30."""
    f = lambda a, n: F.floor(F.col(a) / n).alias(a)
    return vox(spark, sf_dir).groupBy(f("z", 2), f("y", 4), f("x", 4)).agg((F.avg("value") > 30).cast("long").alias("value"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two labelings of the rows of lineitem."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 7).alias("seg"), ((F.col("l_suppkey") + F.col("l_partkey") % 3) % 5).alias("gt"))


def pre(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("pre_idx"), (F.col("o_orderkey") % 97).alias("z"), (F.col("o_custkey") % 101).alias("y"), F.floor(F.col("o_totalprice") % 103).cast("long").alias("x"), F.col("o_orderpriority").alias("user"))


def post(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One post for each row of lineitem, numbered within its order; conf from 0.5 to 0.6."""
    own = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = table(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(own))
    p, s, q = (F.col(c) for c in ("l_partkey", "l_suppkey", "l_quantity"))
    return rows.select((F.col("l_orderkey") * 4096 + F.col("k")).alias("post_idx"), F.col("l_orderkey").alias("pre_idx"), (p % 97).alias("z"), (s % 101).alias("y"), F.floor(q).cast("long").alias("x"), (F.lit(0.5) + q / 500).alias("conf"))


def op_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select((F.floor(F.col("event_id") / 5)).alias("task_id"), F.col("event_type").alias("operator"), F.col("value").alias("seconds"), F.concat(F.lit("device"), (F.col("user_id") % 3).cast("string")).alias("compute_device"))


#: the same views for DuckDB
SQL = {
    "vox": """vox AS (
  SELECT g.z, g.y, g.x, coalesce(v.value, 0) AS value
  FROM (SELECT a.i AS z, b.i AS y, c.i AS x FROM (SELECT unnest(range(8)) AS i) a, (SELECT unnest(range(32)) AS i) b, (SELECT unnest(range(32)) AS i) c) g
  LEFT JOIN (SELECT l_partkey % 8 AS z, l_suppkey % 32 AS y, l_orderkey % 32 AS x, CAST(sum(CAST(floor(l_quantity * 5) AS BIGINT)) % 251 AS BIGINT) AS value FROM lineitem GROUP BY 1, 2, 3) v USING (z, y, x))""",
    "lab": "lab AS (SELECT z, y, x, value // 20 AS value FROM vox)",
    "prob": """cells AS (
  SELECT l_partkey % 8 AS z, l_suppkey % 32 AS y, l_orderkey % 32 AS x, min(l_discount * 10) AS v0, min(l_tax * 12) AS v1, min(l_quantity / 50) AS v2 FROM lineitem GROUP BY 1, 2, 3
), prob AS (SELECT CAST(0 AS BIGINT) AS c, z, y, x, v0 AS value FROM cells UNION ALL SELECT 1, z, y, x, v1 FROM cells UNION ALL SELECT 2, z, y, x, v2 FROM cells)""",
    "coarse": "coarse AS (SELECT z // 2 AS z, y // 4 AS y, x // 4 AS x, CAST(avg(value) > 30 AS BIGINT) AS value FROM vox GROUP BY 1, 2, 3)",
    "pairs": "pairs AS (SELECT l_partkey % 7 AS seg, (l_suppkey + l_partkey % 3) % 5 AS gt FROM lineitem)",
    "tab0": "tab0 AS (SELECT * FROM tab WHERE seg <> 0 AND gt <> 0)",
    "tab": "tab AS (SELECT seg, gt, count(*) AS n FROM pairs GROUP BY 1, 2)",
    "pre": "pre AS (SELECT o_orderkey AS pre_idx, o_orderkey % 97 AS z, o_custkey % 101 AS y, CAST(floor(o_totalprice % 103) AS BIGINT) AS x, o_orderpriority AS \"user\" FROM orders)",
    "post": """post AS (
  SELECT l_orderkey * 4096 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS post_idx, l_orderkey AS pre_idx, l_partkey % 97 AS z, l_suppkey % 101 AS y, CAST(floor(l_quantity) AS BIGINT) AS x, 0.5 + l_quantity / 500 AS conf
  FROM lineitem)""",
    "op_log": "op_log AS (SELECT event_id // 5 AS task_id, event_type AS operator, value AS seconds, 'device' || CAST(user_id % 3 AS VARCHAR) AS compute_device FROM events)",
}
NEEDS = {"lab": ["vox"], "coarse": ["vox"], "tab": ["pairs"], "tab0": ["pairs", "tab"]}


def with_views(names: str, body: str) -> str:
    """body after the common table expressions of the named views."""
    order: list[str] = []
    for n in names.split():
        for m in [*NEEDS.get(n, []), n]:
            if m not in order:
                order.append(m)
    return f"WITH RECURSIVE {', '.join(SQL[n] for n in order)}\n{body}"
