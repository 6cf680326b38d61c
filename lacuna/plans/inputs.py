"""The driver's tables read as points, zones, test points and edits; each with the same derivation in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators import lattice


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def points(spark: SparkSession, d: str) -> DataFrame:
    """Customers as points: id, x, y, depth and test flags."""
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has_txt", F.lit(True))
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment").join(urgent, "c_custkey", "left")
    return c.selectExpr("c_custkey AS id", "CAST((c_custkey * 7919) % 10007 AS DOUBLE) AS x", "CAST((c_custkey * 104729) % 10009 AS DOUBLE) AS y", "CAST(c_acctbal AS DOUBLE) AS depth", "c_mktsegment < 'C' AS has_spt", "coalesce(has_txt, false) AS has_txt", "c_custkey % 2 = 0 AS has_txe")


POINTS = """pts AS (SELECT c_custkey AS id, CAST((c_custkey * 7919) % 10007 AS DOUBLE) AS x, CAST((c_custkey * 104729) % 10009 AS DOUBLE) AS y, CAST(c_acctbal AS DOUBLE) AS depth, c_mktsegment < 'C' AS has_spt,
  c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS has_txt, c_custkey % 2 = 0 AS has_txe FROM customer)"""


def sites(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as sites: id, x, y."""
    return table(spark, d, "supplier").selectExpr("s_suppkey AS id", "CAST((s_suppkey * 15485863) % 10007 AS DOUBLE) AS x", "CAST((s_suppkey * 32452843) % 10009 AS DOUBLE) AS y")


SITES = "sites AS (SELECT s_suppkey AS id, CAST((s_suppkey * 15485863) % 10007 AS DOUBLE) AS x, CAST((s_suppkey * 32452843) % 10009 AS DOUBLE) AS y FROM supplier)"


def zones(spark: SparkSession, d: str, grow: float = 0.0) -> DataFrame:
    """Nations as a grid of square zones, enlarged by grow on each side."""
    return table(spark, d, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS zone", "n_name AS zone_name", "CAST(100 + 50 * n_regionkey AS DOUBLE) AS spacing", "CAST(n_nationkey AS INT) AS ord", *(f"CAST({e} AS DOUBLE) AS {n}" for n, e in _box(grow)))


def _box(grow: float) -> list[tuple[str, str]]:
    g = f"{grow:.1f}"
    ix, iy = "(n_nationkey % 5)", "floor(n_nationkey / CAST(5 AS DOUBLE))"
    return [("x0", f"2000 * {ix} - {g}"), ("y0", f"2000 * {iy} - {g}"), ("x1", f"2000 * ({ix} + 1) + {g}"), ("y1", f"2000 * ({iy} + 1) + {g}")]


def zones_sql(grow: float = 0.0) -> str:
    return "zones AS (SELECT CAST(n_nationkey AS BIGINT) AS zone, n_name AS zone_name, CAST(100 + 50 * n_regionkey AS DOUBLE) AS spacing, CAST(n_nationkey AS INT) AS ord, " + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in _box(grow)) + " FROM nation)"


def tests(spark: SparkSession, d: str, factor: float) -> DataFrame:
    """Test points of each zone on a hexagonal lattice of factor times its spacing: zone, row, k, x, y, required_radius."""
    z = zones(spark, d).withColumn("step", F.col("spacing") * F.lit(factor))
    return lattice.box_lattice(z, "step").select("zone", "row", "k", "x", "y", F.col("spacing").alias("required_radius"))


def tests_sql(factor: float) -> str:
    row = f"CAST({lattice.ROW!r} AS DOUBLE)"
    return f"""tp AS (SELECT zone, r AS "row", k, x, y, spacing AS required_radius FROM (
  SELECT zone, r, k, spacing, x0, x1, y0, y1, x0 + CASE WHEN r % 2 = 1 THEN step / 2 ELSE CAST(0 AS DOUBLE) END + k * step AS x, y0 + r * (step * {row}) AS y
  FROM (SELECT *, unnest(range(0, CAST(ceil((x1 - x0) / step) AS BIGINT) + 1)) AS k FROM (SELECT *, unnest(range(0, CAST(ceil((y1 - y0) / (step * {row})) AS BIGINT) + 1)) AS r FROM (SELECT *, spacing * CAST({factor} AS DOUBLE) AS step FROM zones))))
  WHERE x > x0 AND x < x1 AND y > y0 AND y < y1)"""


def cells(spark: SparkSession, d: str, h: float, grow: float = 0.0) -> DataFrame:
    """Lattice cells of each zone: zone, spacing, ord, ix, iy."""
    from lacuna.operators.region import box_cells

    return box_cells(zones(spark, d, grow), h, ["zone", "spacing", "ord"])


def cells_sql(h: float) -> str:
    """Over the zones CTE."""
    hh = f"CAST({h} AS DOUBLE)"
    span = lambda a, b: f"unnest(range(CAST(ceil({a} / {hh} - CAST(0.5 AS DOUBLE)) AS BIGINT), CAST(ceil({b} / {hh} - CAST(0.5 AS DOUBLE)) AS BIGINT)))"
    return f"cells AS (SELECT *, {span('y0', 'y1')} AS iy FROM (SELECT *, {span('x0', 'x1')} AS ix FROM zones))"


def own_cells(spark: SparkSession, d: str) -> DataFrame:
    """Lattice cells of each zone at its own resolution h, the largest power of two of at most spacing / 10: zone, spacing, h, ix, iy."""
    from lacuna.operators.region import box_cells

    return box_cells(zones(spark, d).withColumn("h", F.pow(F.lit(2.0), F.floor(F.log2(F.col("spacing") / 10)))), "h", ["zone", "spacing", "h"])


def own_cells_sql() -> str:
    """Over the zones CTE."""
    span = lambda a, b: f"unnest(range(CAST(ceil({a} / h - CAST(0.5 AS DOUBLE)) AS BIGINT), CAST(ceil({b} / h - CAST(0.5 AS DOUBLE)) AS BIGINT)))"
    return f"""grid AS (SELECT *, pow(CAST(2 AS DOUBLE), floor(log2(spacing / 10))) AS h FROM zones),
cells AS (SELECT *, {span('y0', 'y1')} AS iy FROM (SELECT *, {span('x0', 'x1')} AS ix FROM grid))"""


def edits(spark: SparkSession, d: str) -> DataFrame:
    """Events as edits: seq, ts, id, action, x, y."""
    return table(spark, d, "events").where("event_type IN ('signup', 'click', 'error', 'purchase')").selectExpr(
        "event_id AS seq", "ts", "CAST(user_id AS BIGINT) AS id", "CASE event_type WHEN 'signup' THEN 'add' WHEN 'click' THEN 'move' WHEN 'error' THEN 'delete' ELSE 'restore' END AS action",
        "CAST((event_id * 7919) % 10007 AS DOUBLE) AS x", "CAST((event_id * 104729) % 10009 AS DOUBLE) AS y")


EDITS = """edits AS (SELECT event_id AS seq, ts, CAST(user_id AS BIGINT) AS id, CASE event_type WHEN 'signup' THEN 'add' WHEN 'click' THEN 'move' WHEN 'error' THEN 'delete' ELSE 'restore' END AS action,
  CAST((event_id * 7919) % 10007 AS DOUBLE) AS x, CAST((event_id * 104729) % 10009 AS DOUBLE) AS y FROM events WHERE event_type IN ('signup', 'click', 'error', 'purchase'))"""

#: The edits of an id one after the other, from its base position: id, n (how many are done), there, x, y, edited; over pts and edits.
FOLDED = """turn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS n FROM edits),
home AS (SELECT coalesce(p.id, e.id) AS id, p.id IS NOT NULL AS known, p.x AS hx, p.y AS hy FROM pts p FULL JOIN (SELECT DISTINCT id FROM edits) e ON p.id = e.id),
fold(id, n, known, hx, hy, there, x, y, edited) AS (SELECT id, CAST(0 AS BIGINT), known, hx, hy, known, hx, hy, FALSE FROM home
  UNION ALL SELECT f.id, t.n, known, hx, hy, CASE action WHEN 'add' THEN TRUE WHEN 'delete' THEN FALSE WHEN 'restore' THEN known ELSE there END,
    CASE WHEN action = 'add' OR (action = 'move' AND there) THEN t.x WHEN action = 'restore' THEN hx ELSE f.x END,
    CASE WHEN action = 'add' OR (action = 'move' AND there) THEN t.y WHEN action = 'restore' THEN hy ELSE f.y END,
    CASE WHEN action = 'add' THEN TRUE WHEN action = 'move' THEN there WHEN action = 'restore' THEN FALSE ELSE edited END
  FROM fold f JOIN turn t ON t.id = f.id AND t.n = f.n + 1),
ended AS (SELECT * FROM fold f WHERE n = (SELECT max(n) FROM fold g WHERE g.id = f.id) AND there)"""
