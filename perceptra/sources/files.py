"""Readers and writers of scan, label, calibration, log, voxel and grid files. All go through Spark's own file sources."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.trees import discard

#: Fixed values of the label format.
KINDS = ["Car", "Van", "Truck", "Pedestrian", "Person_sitting", "Cyclist", "Tram", "Misc", "DontCare"]
LABEL = "type string, truncated double, occluded double, alpha double, x1 double, y1 double, x2 double, y2 double, h double, w double, l double, x double, y double, z double, rotation_y double"
FRAME = r"(\d+)\.[a-z]+$"


def _frame(path: str = "path"):
    return F.regexp_extract(F.col(path), FRAME, 1).cast("int")


def _binary(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")


def read_scans(spark: SparkSession, path: str) -> DataFrame:
    """Records of four little-endian 32-bit floats, in order; an incomplete last one is left out."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, raw in zip(f.frame, f.content, strict=True):
                a = np.frombuffer(raw[: len(raw) // 16 * 16], "<f4").reshape(-1, 4)
                yield pd.DataFrame({"frame": np.int32(p), "hit_idx": np.arange(len(a), dtype=np.int32), **{c: a[:, n].astype(float) for n, c in enumerate(("x", "y", "z", "intensity"))}})

    return _binary(spark, path, "*.bin").select(_frame().alias("frame"), "content").mapInPandas(parse, "frame int, hit_idx int, x double, y double, z double, intensity double")


def _framed(rows: DataFrame) -> DataFrame:
    """Adds frame: the folder's (frame=7), as the writers here leave it, else the number in the file's name."""
    frame = F.col("frame").cast("int") if "frame" in rows.columns else _frame("_metadata.file_path")
    return rows.select(*[c for c in rows.columns if c != "frame"], frame.alias("frame"))


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return _framed(spark.read.schema(schema).option("sep", " ").csv(path))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth of 15 columns (S2, S11); kinds by equality, unknown ones null (Q23)."""
    return _rows(spark, path, LABEL).withColumn("type", F.when(F.col("type").isin(KINDS), F.col("type")))


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """Detections of 16 columns."""
    return _rows(spark, path, LABEL + ", score double")


def evaluable(det: DataFrame) -> DataFrame:
    """Which metrics the detections allow (S11): image boxes, ground positions, solids, and orientation unless an alpha is -10."""
    return det.agg(
        F.bool_or(F.col("x1") >= 0).alias("image"), F.bool_or((F.col("x") != -1000) & (F.col("z") != -1000) & (F.col("w") > 0) & (F.col("l") > 0)).alias("ground"),
        F.bool_or((F.col("y") != -1000) & (F.col("h") > 0)).alias("box3d"), F.bool_and(F.col("alpha") != -10).alias("orientation"),
    )


def care(labels: DataFrame) -> DataFrame:
    """(F6)"""
    return labels.where(F.col("type") != "DontCare")


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """Matrices as arrays by frame (S3, S4): lines with the prefixes of projection, rectification and sensor position."""
    lines = _framed(spark.read.text(path))
    numbers = lambda prefix: F.max(F.when(F.startswith("value", F.lit(prefix)), F.split(F.trim(F.substring_index("value", ":", -1)), " +").cast("array<double>")))
    return lines.groupBy("frame").agg(numbers("P2: ").alias("p"), numbers("R0_rect: ").alias("r_rect"), numbers("Tr_velo_to_cam: ").alias("t_cv"))


#: Prefixes of the camera's lines, and the columns they are read as.
CAMERA = {"P_rect_02": "p", "R_rect_00": "r_rect", "R": "r", "T": "t"}


def read_camera(spark: SparkSession, path: str) -> DataFrame:
    """Intrinsics and extrinsics of each recording day by prefix (S4), in a file (000007.txt) or a folder a day (day=7); other lines are left out, a missing one is null."""
    lines = spark.read.text(path)
    lines = lines if "day" in lines.columns else lines.withColumn("day", _frame("_metadata.file_path"))
    numbers = lambda prefix: F.max(F.when(F.startswith("value", F.lit(prefix + ": ")), F.split(F.trim(F.substring_index("value", ":", -1)), " +").cast("array<double>")))
    return lines.groupBy("day").agg(*[numbers(p).alias(n) for p, n in CAMERA.items()])


def write_camera(cameras: DataFrame, path: str) -> None:
    """Camera files (day, p, r_rect, r, t) as a text file for each day; what read_camera reads."""
    line = lambda name, c: F.concat_ws(" ", F.lit(f"{name}:"), F.col(c).cast("array<string>"))
    lines = F.concat_ws("\n", F.lit("calib_time: 09-Jan-2012 13:57:47"), *[line(p, n) for p, n in CAMERA.items()])
    write_texts(cameras.select("day", lines.alias("value")), "day", path)


def write_texts(rows: DataFrame, key: str, path: str) -> None:
    """A text file for each row (key, value), named by its key, in one folder: tasks write them beside one another, where a folder for each is made and moved by the driver alone."""
    name = F.concat(F.lpad(F.col(key).cast("string"), F.greatest(F.lit(6), F.length(F.col(key).cast("string"))), F.lit("0")), F.lit(".txt"))
    rows = rows.select(name.alias("name"), F.concat("value", F.lit("\n")).cast("binary").alias("content"))
    discard(rows.sparkSession, path)  # overwrites what lies there
    write_binary(rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism), path)


def write_labels(labels: DataFrame, path: str) -> None:
    """Lines of 15 columns in a folder for each frame; what read_labels reads."""
    names = [c.split()[0] for c in LABEL.split(", ")]
    line = F.concat_ws(" ", "type", *[F.format_string("%.2f", F.col(c).cast("double")) for c in names[1:]])
    labels.select("frame", line.alias("value")).write.mode("overwrite").partitionBy("frame").text(path)


def voxel_files(grids: DataFrame, name: str = "name", grid: str = "grid", header: int = 24) -> DataFrame:
    """Rows (name, content) of one voxel array a file, 32-bit floats after an empty header (S12, S14); what read_voxels reads."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"name": f[name], "content": [bytes(header) + np.asarray(g, "<f4").tobytes() for g in f[grid]]})

    return grids.select(name, grid).mapInPandas(pack, "name string, content binary")


def read_tracklets(spark: SparkSession, path: str) -> DataFrame:
    """Tracklets with their poses, one row a frame (S5, J9); broken rows are left out."""
    pose = "struct<tx:double,ty:double,tz:double,rx:double,ry:double,rz:double,state:int,occlusion:int>"
    schema = f"objectType string, h double, w double, l double, first_frame int, poses struct<item:array<{pose}>>, finished int"
    t = spark.read.format("xml").option("rowTag", "tracklet").option("mode", "PERMISSIVE").schema(schema).load(path)
    rows = t.withColumn("tracklet_id", F.monotonically_increasing_id()).select("tracklet_id", "objectType", "h", "w", "l", "first_frame", F.posexplode("poses.item").alias("n", "pose"))
    return rows.select("tracklet_id", F.col("objectType").alias("type"), "h", "w", "l", (F.col("first_frame") + F.col("n")).alias("frame"), "pose.*")


def read_laser_log(spark: SparkSession, path: str, far: float = 80.0) -> DataFrame:
    """Beams of FLASER lines as points (S6): 180 ranges from -90 degrees, pose after them, ranges of far or more left out."""
    t = F.split("value", " ")
    lines = spark.read.text(path).where(F.startswith("value", F.lit("FLASER"))).select(F.monotonically_increasing_id().alias("line_no"), F.slice(t, 3, 180).cast("array<double>").alias("ranges"), *[F.element_at(t, 183 + n).cast("double").alias(c) for n, c in enumerate(("ox", "oy", "heading"))])
    beam = lines.select("line_no", "ox", "oy", "heading", F.posexplode("ranges").alias("beam", "r")).where(F.col("r") < far)
    a = F.col("heading") + F.radians(F.col("beam") - 90.0)
    return beam.select("line_no", "beam", (F.col("ox") + F.col("r") * F.cos(a)).alias("x"), (F.col("oy") + F.col("r") * F.sin(a)).alias("y"), F.col("ox").alias("origin_x"), F.col("oy").alias("origin_y"))


def read_voxels(spark: SparkSession, path: str, glob: str = "*df", header: int = 24, side: int = 32) -> DataFrame:
    """Dense voxel arrays after a header."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": f.path, "grid": [np.frombuffer(raw[header : header + 4 * side**3], "<f4") for raw in f.content]})

    return _binary(spark, path, glob).mapInPandas(parse, "path string, grid array<float>")


def paired(voxels: DataFrame) -> DataFrame:
    """Partial scans with the complete shape of the same name."""
    full = voxels.where(F.endswith("path", F.lit(".df"))).select(F.col("path").alias("full_path"), F.col("grid").alias("full"))
    part = voxels.where(F.endswith("path", F.lit(".sdf"))).withColumn("full_path", F.regexp_replace("path", r"__\d+__\.sdf$", "__0__.df"))
    return part.join(full, "full_path")


def read_sparse_grids(spark: SparkSession, path: str, half: int = 16) -> DataFrame:
    """Signs of sparse grids within a cube (S13): resolution, count, cells, log-odds."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, raw in zip(f.path, f.content, strict=True):
                n = int(np.frombuffer(raw, "<u8", 1, 4)[0])
                cell, lo = np.frombuffer(raw, "<i4", 3 * n, 12).reshape(-1, 3), np.frombuffer(raw, "<f4", n, 12 + 12 * n)
                ok = ((cell >= -half) & (cell < half)).all(1)
                yield pd.DataFrame({"path": p, "i": cell[ok, 0], "j": cell[ok, 1], "k": cell[ok, 2], "sign": np.sign(lo[ok]).astype(np.int32), "log_odds": lo[ok].astype(float)})

    return _binary(spark, path, "*.sog").mapInPandas(parse, "path string, i int, j int, k int, sign int, log_odds double")


def sparse_grid_bytes(cells: np.ndarray, log_odds: np.ndarray, res: float) -> bytes:
    """One grid in the sparse format (K9)."""
    return np.float32(res).tobytes() + np.uint64(len(cells)).tobytes() + cells.astype("<i4").tobytes() + log_odds.astype("<f4").tobytes()


def unscaled(grid: str = "grid"):
    """Distances from their logarithms (K9)."""
    return F.transform(F.col(grid), lambda v: F.expm1(v))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Headerless numeric columns."""
    return spark.read.schema(schema).csv(path)


def read_frame(scans: DataFrame, labels: DataFrame, calibration: DataFrame) -> DataFrame:
    """Scan, labels and calibration by frame (S10): labels as one array."""
    per_frame = labels.groupBy("frame").agg(F.collect_list(F.struct(*[c for c in labels.columns if c != "frame"])).alias("labels"))
    return scans.join(per_frame, "frame", "left").join(calibration, "frame", "left")


def write_detections(det: DataFrame, path: str) -> None:
    """Lines of 16 columns in a folder for each frame (K1)."""
    line = F.concat_ws(" ", "type", *[F.format_string("%.2f", F.col(c).cast("double")) for c in det.columns if c not in ("frame", "type")])
    det.select("frame", line.alias("value")).write.mode("overwrite").partitionBy("frame").text(path)


def save_grids(grids: DataFrame, path: str, by: list[str]) -> None:
    """Grids or models in a folder for each class (K2, K3)."""
    grids.write.mode("overwrite").partitionBy(*by).parquet(path)


def load_grids(spark: SparkSession, path: str, classes: list[str] | None = None, by: str = "class") -> DataFrame:
    """(S7, S8, S9): folders of other classes are pruned, not read."""
    g = spark.read.parquet(path)
    return g.where(F.col(by).isin(classes)) if classes else g


def write_csv(df: DataFrame, path: str) -> None:
    """Headerless results (K5, K6, K7)."""
    df.write.mode("overwrite").csv(path)


def write_calibration(calibration: DataFrame, path: str) -> None:
    """Matrices (frame, p, r_rect, t_cv) as a text file for each frame; what read_calibration reads."""
    line = lambda name, c: F.concat_ws(" ", F.lit(f"{name}:"), F.col(c).cast("array<string>"))
    lines = F.concat_ws("\n", line("P2", "p"), line("R0_rect", "r_rect"), line("Tr_velo_to_cam", "t_cv"))
    write_texts(calibration.select("frame", lines.alias("value")), "frame", path)


def write_tracklets(tracklets: DataFrame, path: str) -> None:
    """Tracklets (objectType, h, w, l, first_frame, poses, finished) as XML; what read_tracklets reads."""
    tracklets.write.format("xml").option("rootTag", "tracklets").option("rowTag", "tracklet").mode("overwrite").save(path)


def write_laser_log(lines: DataFrame, path: str) -> None:
    """FLASER lines (ranges, ox, oy, heading); what read_laser_log reads."""
    value = F.concat_ws(" ", F.lit("FLASER"), F.size("ranges").cast("string"), F.col("ranges").cast("array<string>"), *[F.col(c).cast("string") for c in ("ox", "oy", "heading")])
    lines.select(value.alias("value")).write.mode("overwrite").text(path)


def write_binary(rows: DataFrame, path: str) -> int:
    """A file for each row (name, content) in one folder that the tasks reach; returns how many. A repeated attempt writes the same file again."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(base, recursive=True)
        for f in frames:
            for name, content in zip(f.name, f.content, strict=True):
                with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
                    out.write(content)
            yield pd.DataFrame({"n": [len(f)]})

    return rows.select("name", "content").mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0


def scan_files(scans: DataFrame, frame: str = "frame") -> DataFrame:
    """Rows (name, content) of one scan a file, records of four 32-bit floats in the order of hit_idx; a scan is bounded by its sensor."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        data = pdf.sort_values("hit_idx")[["x", "y", "z", "intensity"]].to_numpy("<f4").tobytes()
        return pd.DataFrame({"name": [f"{int(pdf[frame].iloc[0]):06d}.bin"], "content": [data]})

    return scans.groupBy(frame).applyInPandas(pack, "name string, content binary")


def sparse_grid_files(grids: DataFrame, by: str, res: float) -> DataFrame:
    """Rows (name, content) of one sparse grid (i, j, k, log_odds) a file (K9)."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"name": [f"{pdf[by].iloc[0]}.sog"], "content": [sparse_grid_bytes(pdf[["i", "j", "k"]].to_numpy(), pdf["log_odds"].to_numpy(), res)]})

    return grids.groupBy(by).applyInPandas(pack, "name string, content binary")
