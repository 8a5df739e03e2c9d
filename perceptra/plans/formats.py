"""Queries that write the adapter's rows in a file format and read them back: the result is what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.trees import shared_folder
from ..registry import query
from ..sources import files
from ..sources.adapters import BOXES_SQL, HITS_SQL, detections, hits, table


@query(f"WITH {HITS_SQL} SELECT CAST(scan_id AS INTEGER) AS frame, hit_idx, round(CAST(CAST(x AS FLOAT) AS DOUBLE), 5) AS x, round(CAST(CAST(y AS FLOAT) AS DOUBLE), 5) AS y, round(CAST(CAST(z AS FLOAT) AS DOUBLE), 5) AS z, round(CAST(CAST(intensity AS FLOAT) AS DOUBLE), 5) AS intensity FROM hits")
def scan_files(spark, sf_dir):
    path = shared_folder(spark, "scans")
    files.write_binary(files.scan_files(hits(spark, sf_dir).withColumnRenamed("scan_id", "frame")), path)
    return files.read_scans(spark, path).withColumns({c: F.round(c, 5) for c in ("x", "y", "z", "intensity")})


def _detection_lines(spark, sf_dir):
    d = detections(spark, sf_dir)
    n = F.col("box_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in files.KINDS]), (n % len(files.KINDS) + 1).cast("int"))
    values = {"type": kind, "truncated": n % 10 / 10.0, "occluded": n % 4, "alpha": n % 7 / 4.0, "h": n % 3 + 1.5, "w": n % 5 + 1.25, "l": n % 6 + 2.5, "x": n % 40 - 20.0, "y": n % 3 / 2.0, "z": n % 60, "rotation_y": n % 5 / 2.0}
    names = [c.split()[0] for c in files.LABEL.split(", ")]
    d = d.withColumns(values)
    return d.select("frame", *[F.col(c) if c == "type" else F.col(c).cast("double").alias(c) for c in names], F.floor(F.col("score") * 64).cast("double").alias("score"))


KINDS_SQL = "[" + ", ".join(f"'{k}'" for k in files.KINDS) + "]"
LINES = f"""lines AS (
  SELECT CAST(frame AS INTEGER) AS frame, ({KINDS_SQL})[box_id % {len(files.KINDS)} + 1] AS type, (box_id % 10)/10.0::DOUBLE AS truncated, CAST(box_id % 4 AS DOUBLE) AS occluded, round((box_id % 7)/4.0::DOUBLE, 2) AS alpha,
         x1, y1, x2, y2, box_id % 3 + 1.5::DOUBLE AS h, box_id % 5 + 1.25::DOUBLE AS w, box_id % 6 + 2.5::DOUBLE AS l, box_id % 40 - 20.0::DOUBLE AS x, round((box_id % 3)/2.0::DOUBLE, 2) AS y, CAST(box_id % 60 AS DOUBLE) AS z,
         (box_id % 5)/2.0::DOUBLE AS rotation_y, floor(score*64) AS score FROM det)"""
PLAIN = ["truncated", "occluded", "alpha", "h", "w", "l", "x", "y", "z", "rotation_y", "score"]


def _written_detections(spark, sf_dir):
    path = shared_folder(spark, "detections")
    files.write_detections(_detection_lines(spark, sf_dir), path)
    return files.read_detections(spark, path)


@query(f"WITH {BOXES_SQL}, {LINES} SELECT frame, type, {', '.join(PLAIN)} FROM lines WHERE type <> 'DontCare'")
def detection_files(spark, sf_dir):
    return files.care(_written_detections(spark, sf_dir)).select("frame", "type", *PLAIN)


@query(f"WITH {BOXES_SQL}, {LINES} SELECT bool_or(x1 >= 0) AS image, bool_or(x <> -1000 AND z <> -1000 AND w > 0 AND l > 0) AS ground, bool_or(y <> -1000 AND h > 0) AS box3d, bool_and(alpha <> -10) AS orientation FROM lines")
def evaluable_metrics(spark, sf_dir):
    return files.evaluable(_written_detections(spark, sf_dir))


@query("""SELECT CAST(s_suppkey AS INTEGER) AS frame, list_transform(range(12), lambda i: CAST(s_suppkey % 7 + i AS DOUBLE)) AS p, list_transform(range(9), lambda i: i/4.0::DOUBLE) AS r_rect,
list_transform(range(12), lambda i: CAST(s_nationkey - i AS DOUBLE)) AS t_cv FROM supplier""")
def calibration_files(spark, sf_dir):
    s, path = table(spark, sf_dir, "supplier"), shared_folder(spark, "calibration")
    upto = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    c = s.select(F.col("s_suppkey").alias("frame"), F.transform(upto(12), lambda i: (F.col("s_suppkey") % 7 + i).cast("double")).alias("p"), F.transform(upto(9), lambda i: i / 4.0).alias("r_rect"), F.transform(upto(12), lambda i: (F.col("s_nationkey") - i).cast("double")).alias("t_cv"))
    files.write_calibration(c, path)
    return files.read_calibration(spark, path)


@query("""SELECT n_name AS type, 1.5::DOUBLE AS h, n_regionkey + 0.5::DOUBLE AS w, 4.0::DOUBLE AS l, CAST(n_nationkey + k AS INTEGER) AS frame, n_nationkey*0.5::DOUBLE AS tx, k*0.25::DOUBLE AS ty, CAST(k % 3 AS INTEGER) AS state
FROM nation, range(25) r(k) WHERE k <= n_nationkey % 5""")
def tracklet_files(spark, sf_dir):
    n, path = table(spark, sf_dir, "nation"), shared_folder(spark, "tracklets")
    k = F.sequence(F.lit(0).cast("long"), F.col("n_nationkey").cast("long") % 5)
    zero = lambda name: F.lit(0.0).alias(name)
    pose = lambda i: F.struct((F.col("n_nationkey") * 0.5).alias("tx"), (i * 0.25).alias("ty"), zero("tz"), zero("rx"), zero("ry"), zero("rz"), (i % 3).cast("int").alias("state"), F.lit(0).alias("occlusion"))
    t = n.select(F.col("n_name").alias("objectType"), F.lit(1.5).alias("h"), (F.col("n_regionkey") + 0.5).alias("w"), F.lit(4.0).alias("l"), F.col("n_nationkey").cast("int").alias("first_frame"), F.struct(F.transform(k, pose).alias("item")).alias("poses"), F.lit(1).alias("finished"))
    files.write_tracklets(t, path)
    return files.read_tracklets(spark, path).select("type", "h", "w", "l", F.col("frame").cast("int").alias("frame"), "tx", "ty", "state")


@query("""SELECT c_custkey AS log, CAST(b AS INTEGER) AS beam, round(c_custkey + r*cos(h + (b - 90)*pi()/180), 6) AS x, round(r*sin(h + (b - 90)*pi()/180), 6) AS y
FROM (SELECT c_custkey, b, c_nationkey*0.125::DOUBLE AS h, (c_custkey*7 + b*3) % 100 + 0.5::DOUBLE AS r FROM customer, range(180) t(b)) WHERE r < 80""")
def laser_log_files(spark, sf_dir):
    c, path = table(spark, sf_dir, "customer"), shared_folder(spark, "laser")
    ranges = F.transform(F.sequence(F.lit(0), F.lit(179)), lambda b: (F.col("c_custkey") * 7 + b * 3) % 100 + 0.5)
    files.write_laser_log(c.select(ranges.alias("ranges"), F.col("c_custkey").alias("ox"), F.lit(0.0).alias("oy"), (F.col("c_nationkey") * 0.125).alias("heading")), path)
    return files.read_laser_log(spark, path).select(F.col("origin_x").cast("long").alias("log"), "beam", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"WITH {HITS_SQL} SELECT scan_id, hit_idx, round(x, 6) AS x, round(y, 6) AS y, cls FROM hits WHERE cls IN (1, 3)")
def grids_by_class(spark, sf_dir):
    path = shared_folder(spark, "grids")
    files.save_grids(hits(spark, sf_dir).select("scan_id", "hit_idx", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "cls"), path, ["cls"])
    g = files.load_grids(spark, path, [1, 3], by="cls")
    return g.select("scan_id", "hit_idx", "x", "y", F.col("cls").cast(hits(spark, sf_dir).schema["cls"].dataType).alias("cls"))


@query("SELECT event_id, user_id, round(value, 4) AS value FROM events")
def csv_files(spark, sf_dir):
    path = shared_folder(spark, "csv")
    files.write_csv(table(spark, sf_dir, "events").select("event_id", "user_id", F.round("value", 4).alias("value")), path)
    return files.read_csv(spark, path, "event_id long, user_id long, value double")


@query(f"""WITH {HITS_SQL}, c AS (SELECT scan_id, CAST(floor(x) AS INTEGER) AS i, CAST(floor(y) AS INTEGER) AS j, CAST(floor(z) AS INTEGER) AS k, count(*)/2.0::DOUBLE - 0.75 AS lo FROM hits GROUP BY ALL)
SELECT scan_id || '.sog' AS name, i, j, k, CAST(sign(lo) AS INTEGER) AS sign, lo AS log_odds FROM c WHERE i BETWEEN -16 AND 15 AND j BETWEEN -16 AND 15 AND k BETWEEN -16 AND 15""")
def sparse_grid_files(spark, sf_dir):
    path = shared_folder(spark, "sparse")
    cells = hits(spark, sf_dir).groupBy("scan_id", *[F.floor(c).cast("int").alias(n) for c, n in zip("xyz", "ijk", strict=True)]).agg((F.count("*") / 2.0 - 0.75).alias("log_odds"))
    files.write_binary(files.sparse_grid_files(cells, "scan_id", 1.0), path)
    return files.read_sparse_grids(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "i", "j", "k", "sign", "log_odds")


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: exp(CAST(v AS DOUBLE)) - 1)), 6) AS total FROM embeddings""")
def unscaled_distances(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("grid"))
    return e.select("vec_id", F.round(F.aggregate(files.unscaled("grid"), F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


def _written_labels(spark, sf_dir):
    path = shared_folder(spark, "labels")
    files.write_labels(_detection_lines(spark, sf_dir), path)
    return files.read_labels(spark, path)


@query(f"WITH {BOXES_SQL}, {LINES} SELECT frame, type, {', '.join(c for c in PLAIN if c != 'score')} FROM lines")
def label_files(spark, sf_dir):
    return _written_labels(spark, sf_dir).select("frame", "type", *[c for c in PLAIN if c != "score"])


@query("""SELECT CAST(s_suppkey AS INTEGER) AS day, list_transform(range(12), lambda i: CAST(s_suppkey % 7 + i AS DOUBLE)) AS p, list_transform(range(9), lambda i: i/4.0::DOUBLE) AS r_rect,
list_transform(range(9), lambda i: CAST(s_nationkey + i AS DOUBLE)) AS r, list_transform(range(3), lambda i: CAST(s_nationkey - i AS DOUBLE)) AS t FROM supplier""")
def camera_files(spark, sf_dir):
    path, upto = shared_folder(spark, "camera"), lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    s = table(spark, sf_dir, "supplier")
    c = s.select(
        F.col("s_suppkey").alias("day"), F.transform(upto(12), lambda i: (F.col("s_suppkey") % 7 + i).cast("double")).alias("p"), F.transform(upto(9), lambda i: i / 4.0).alias("r_rect"),
        F.transform(upto(9), lambda i: (F.col("s_nationkey") + i).cast("double")).alias("r"), F.transform(upto(3), lambda i: (F.col("s_nationkey") - i).cast("double")).alias("t"),
    )
    files.write_camera(c, path)
    return files.read_camera(spark, path).select(F.col("day").cast("int").alias("day"), "p", "r_rect", "r", "t")


@query(f"""WITH {HITS_SQL}, {BOXES_SQL}, {LINES}, per AS (SELECT frame, count(*) AS n_labels, sum(h) AS h FROM lines GROUP BY frame)
SELECT CAST(scan_id AS INTEGER) AS frame, hit_idx, round(CAST(CAST(x AS FLOAT) AS DOUBLE), 5) AS x, CAST(coalesce(n_labels, 0) AS INTEGER) AS n_labels, round(coalesce(h, 0), 4) AS label_heights, CAST(s_suppkey % 7 AS DOUBLE) AS p0
FROM hits LEFT JOIN per ON per.frame = scan_id LEFT JOIN supplier ON s_suppkey = scan_id""")
def frame_files(spark, sf_dir):
    """Scans, labels and calibration written in their formats, read again and brought together by frame."""
    scans, calibration, upto = shared_folder(spark, "scans"), shared_folder(spark, "calibration"), lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    files.write_binary(files.scan_files(hits(spark, sf_dir).withColumnRenamed("scan_id", "frame")), scans)
    ones = F.transform(upto(12), lambda i: (F.col("s_suppkey") % 7 + i).cast("double"))
    files.write_calibration(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("frame"), ones.alias("p"), F.slice(ones, 1, 9).alias("r_rect"), ones.alias("t_cv")), calibration)
    f = files.read_frame(files.read_scans(spark, scans), _written_labels(spark, sf_dir), files.read_calibration(spark, calibration))
    labels = F.coalesce("labels", F.array())
    return f.select(
        "frame", "hit_idx", F.round("x", 5).alias("x"), F.size(labels).alias("n_labels"), F.round(F.aggregate(labels, F.lit(0.0), lambda s, b: s + b["h"]), 4).alias("label_heights"), F.get("p", F.lit(0)).alias("p0")
    )


@query("""WITH e AS (SELECT vec_id, list_transform(range(64), lambda i: CAST(embedding[i + 1] AS DOUBLE)) AS g FROM embeddings), p AS (SELECT vec_id, g, vec_id - vec_id % 4 AS shape FROM e)
SELECT a.vec_id, b.vec_id AS full_id, round(list_sum(a.g), 5) AS part_sum, round(list_sum(b.g), 5) AS full_sum FROM p a JOIN p b ON b.vec_id = a.shape WHERE a.vec_id <> b.vec_id""")
def voxel_file_pairs(spark, sf_dir):
    """Voxel files of partial scans, read back beside the complete shape of the same name."""
    path, side = shared_folder(spark, "voxels"), 4
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("n"), F.col("embedding").alias("grid"))
    name = F.concat((F.col("n") - F.col("n") % 4).cast("string"), F.lit("__"), (F.col("n") % 4).cast("string"), F.when(F.col("n") % 4 == 0, "__.df").otherwise("__.sdf"))
    files.write_binary(files.voxel_files(e.select(name.alias("name"), "grid")), path)
    parts = F.split(F.element_at(F.split("path", "/"), -1), "__")
    total = lambda c: F.round(F.aggregate(F.col(c).cast("array<double>"), F.lit(0.0), lambda a, v: a + v), 5)
    own = parts[0].cast("long")
    return files.paired(files.read_voxels(spark, path, side=side)).select((own + parts[1].cast("long")).alias("vec_id"), own.alias("full_id"), total("grid").alias("part_sum"), total("full").alias("full_sum"))


@query("""SELECT vec_id, round(list_sum(list_transform(range(64), lambda i: CAST(embedding[i + 1] AS DOUBLE))), 5) AS total FROM embeddings WHERE vec_id % 4 = 0""")
def dense_voxel_files(spark, sf_dir):
    """Of a folder of voxel files those of complete shapes alone, chosen by name before they are read."""
    path = shared_folder(spark, "voxels")
    e = table(spark, sf_dir, "embeddings").select(F.concat(F.when(F.col("vec_id") % 4 == 0, "full_").otherwise("part_"), F.col("vec_id").cast("string"), F.lit(".df")).alias("name"), F.col("embedding").alias("grid"))
    files.write_binary(files.voxel_files(e, header=0), path)
    v = files.read_voxels(spark, path, "full_*", 0, 4)
    return v.select(F.regexp_extract("path", r"full_(\d+)\.df$", 1).cast("long").alias("vec_id"), F.round(F.aggregate(F.col("grid").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 5).alias("total"))
