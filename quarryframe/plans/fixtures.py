"""Role views over the test tables: the same projection in Spark SQL and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"

VIEWS = {
    "fx_keyframe": """SELECT concat('s', user_id) AS scene_token, event_id AS sample_id, {us} AS timestamp_us,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS walk_idx,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) / 100 AS ego_x,
  CAST(event_id % 97 AS DOUBLE) / 10 AS ego_y, CASE WHEN event_id % 307 <> 0 THEN CAST(event_id % 63 AS DOUBLE) / 10 END AS ego_yaw,
  event_type <> 'error' AS has_camera, event_id % 17 <> 0 AS has_image, event_id % 251 <> 0 AS has_calibration FROM events""",
    "fx_scene": """SELECT concat('s', user_id) AS scene_token, concat('loc', user_id % 5) AS location,
  CASE WHEN hour(min(ts)) >= 6 AND hour(min(ts)) < 18 THEN 'day' ELSE 'night' END AS time_of_day, count(*) AS n_keyframes FROM events GROUP BY user_id""",
    "fx_object": f"""SELECT l_orderkey AS anchor_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}) AS ann_no, l_partkey % 7 AS instance_id,
  CASE l_partkey % 10 WHEN 0 THEN 'car' WHEN 1 THEN 'truck' WHEN 2 THEN 'construction_vehicle' WHEN 3 THEN 'bus' WHEN 4 THEN 'trailer'
    WHEN 5 THEN 'barrier' WHEN 6 THEN 'motorcycle' WHEN 7 THEN 'bicycle' WHEN 8 THEN 'pedestrian' ELSE 'traffic_cone' END AS category,
  CAST(l_partkey % 600 AS DOUBLE) / 10 - 10 AS x_c, CAST((l_suppkey * 7) % 200 AS DOUBLE) / 10 - 10 AS y_c,
  (l_quantity - 25) / 5 AS vx, CAST((l_partkey * 3 + l_linenumber) % 41 - 20 AS DOUBLE) / 5 AS vy,
  0.5e0 + CAST(l_partkey % 40 AS DOUBLE) / 10 AS box_length_m, 0.4e0 + CAST(l_suppkey % 20 AS DOUBLE) / 10 AS box_width_m,
  CAST((l_suppkey * 13) % 360 AS DOUBLE) AS box_yaw_deg, CAST(l_orderkey % 9 AS DOUBLE) AS ego_speed FROM lineitem""",
    "fx_anchor": """SELECT o_orderkey AS anchor_id, concat('c', o_custkey) AS scene_token,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS walk_idx,
  {days} * 5000 AS timestamp_us, CAST({days} % 90 AS DOUBLE) / 4 AS ego_x, CAST(o_orderkey % 13 AS DOUBLE) / 10 AS ego_y, CAST(o_orderkey % 9 AS DOUBLE) AS ego_speed,
  o_orderkey % 23 <> 0 AS parse_ok, o_orderpriority = '1-URGENT' AS gt_yield, (o_orderkey * 7) % 10 < 3 AS pred_yield,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'STOP' WHEN '2-HIGH' THEN 'DECELERATE' WHEN '3-MEDIUM' THEN 'KEEP_SPEED' WHEN '4-NOT SPECIFIED' THEN 'KEEP_SPEED' ELSE 'ACCELERATE' END AS gt_action,
  CASE (o_orderkey * 11) % 4 WHEN 0 THEN 'STOP' WHEN 1 THEN 'DECELERATE' WHEN 2 THEN 'KEEP_SPEED' ELSE 'ACCELERATE' END AS pred_action FROM orders""",
    "fx_box": f"""SELECT anchor_id, ann_no - 1 AS obj_idx, category,
  CAST(sup % 5 AS INT) * 8 AS x1, CAST(ann_no % 3 AS INT) * 10 AS y1, CAST(sup % 5 AS INT) * 8 + 20 + q AS x2, CAST(ann_no % 3 AS INT) * 10 + 30 AS y2, CAST(prt % 5 AS INT) * 3 AS pred_dx
FROM (SELECT l_orderkey AS anchor_id, l_suppkey AS sup, l_partkey AS prt, CAST(l_quantity AS INT) AS q,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}) AS ann_no, concat('k', l_partkey % 3) AS category FROM lineitem) t WHERE ann_no <= 8""",
}


class Fixtures:
    """Tables and role views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        text = VIEWS[name].replace("{us}", "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").replace("{days}", "CAST(datediff(CAST(o_orderdate AS DATE), DATE '1992-01-01') AS BIGINT)")
        base = text.rsplit("FROM ", 1)[1].split()[0].rstrip(")")
        self.table(base).createOrReplaceTempView(base)
        return self.spark.sql(text)

    def sql(self, query: str, **frames: DataFrame) -> DataFrame:
        return self.spark.sql(query, **frames)


def duck(query: str, *views: str) -> str:
    """A DuckDB query with the named role views in front of its own common tables."""
    days = "CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT)"
    parts = [f"{v} AS ({VIEWS[v].replace('{us}', 'epoch_us(ts)').replace('{days}', days)})" for v in views]
    query = query.strip()
    recursive = query.startswith("WITH RECURSIVE ")
    for head in ("WITH RECURSIVE ", "WITH "):
        if query.startswith(head):
            return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join([*parts, query[len(head) :]])}"
    return f"WITH {', '.join(parts)} {query}" if parts else query
