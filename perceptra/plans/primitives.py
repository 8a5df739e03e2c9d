"""Queries over single expressions, filters and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr
from ..operators import learn, models, rays, sampling
from ..registry import query
from ..sources.adapters import HITS_SQL, hits, table
from . import grids


@query(f"WITH {HITS_SQL} SELECT scan_id, hit_idx, CAST(round_even((x + 40)/80*1023, 0) AS INTEGER) AS slot FROM hits")
def kernel_table_slots(spark, sf_dir):
    return hits(spark, sf_dir).select("scan_id", "hit_idx", expr.table_slot("x", 40.0).alias("slot"))


@query(f"""WITH {HITS_SQL}, d AS (SELECT scan_id, hit_idx, CASE WHEN hit_idx % 5 = 0 THEN 'inf'::DOUBLE ELSE x END AS d FROM hits),
m AS (SELECT scan_id, max(d) AS m FROM d WHERE d < 'inf'::DOUBLE GROUP BY scan_id)
SELECT scan_id, hit_idx, round(ln(1 + abs(CASE WHEN d = 'inf'::DOUBLE THEN m ELSE d END)), 9) AS field FROM d JOIN m USING (scan_id)""")
def log_distances(spark, sf_dir):
    d = hits(spark, sf_dir).select("scan_id", "hit_idx", F.when(F.col("hit_idx") % 5 == 0, float("inf")).otherwise(F.col("x")).alias("d"))
    m = d.where(F.col("d") < float("inf")).groupBy("scan_id").agg(F.max("d").alias("m"))
    return d.join(m, "scan_id").select("scan_id", "hit_idx", F.round(expr.distance_field("d", F.col("m")), 9).alias("field"))


@query("SELECT event_type, count(*) AS n, count(*) >= 2000 AS enough FROM events GROUP BY event_type")
def enough_samples(spark, sf_dir):
    return sampling.class_counts(table(spark, sf_dir, "events"), ["event_type"], 2000)


@query("SELECT event_id, value FROM events WHERE event_id % 3 <> 0")
def valid_samples(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("valid", F.col("event_id") % 3)
    return learn.valid(e).select("event_id", "value")


@query(f"WITH {HITS_SQL} SELECT max(n) AS size FROM (SELECT count(*) AS n FROM hits GROUP BY cls)")
def largest_model(spark, sf_dir):
    return models.largest(hits(spark, sf_dir).groupBy("cls").agg(F.count("*").alias("size")))


@query("SELECT round(sum(-ln(1 + exp(-(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END)*value/100))), 4) AS log_likelihood FROM events")
def points_log_likelihood(spark, sf_dir):
    y = F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)
    points = table(spark, sf_dir, "events").select(y.alias("y_label"), (F.col("value") / 100).alias("f"))
    return learn.log_likelihood(points).select(F.round("log_likelihood", 4).alias("log_likelihood"))


@query(f"WITH {grids.grid_sql(1.0)} SELECT scan_id, i, j, k, n_free, n_occ FROM grid")
def grid_in_order(spark, sf_dir):
    g = grids.grid(spark, sf_dir, 1.0).select("scan_id", "i", "j", "k", "n_free", "n_occ")
    return rays.in_order(g, ["scan_id"])


@query("SELECT user_id, event_id, ts FROM events")
def bucketed_rows(spark, sf_dir):
    return sampling.bucketed(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"])


@query("SELECT user_id, event_id FROM events")
def shuffled_rows(spark, sf_dir):
    return sampling.shuffled(table(spark, sf_dir, "events").select("user_id", "event_id"), 7)
