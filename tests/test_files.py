"""File formats by round trip."""

import numpy as np
from pyspark.sql import functions as F

from perceptra.sources import files


def test_scans(spark, tmp_path):
    a = np.arange(20, dtype="<f4").reshape(5, 4)
    (tmp_path / "000007.bin").write_bytes(a.tobytes() + b"xx")
    rows = files.read_scans(spark, str(tmp_path)).orderBy("hit_idx").collect()
    assert [(r.frame, r.hit_idx, r.x, r.intensity) for r in rows] == [(7, n, a[n, 0], a[n, 3]) for n in range(5)]


def test_labels_and_detections(spark, tmp_path):
    line = "Car 0.00 0 -1.58 587.01 173.33 614.12 200.12 1.65 1.67 3.64 -0.65 1.71 46.70 -1.59"
    (tmp_path / "gt").mkdir()
    (tmp_path / "gt" / "000003.txt").write_text(f"{line}\nDontCare -1 -1 -10 1 2 3 4 -1 -1 -1 -1000 -1000 -1000 -10\nC 0 0 0 1 2 3 4 1 1 1 1 1 1 0\n")
    g = files.read_labels(spark, str(tmp_path / "gt"))
    assert g.where("type IS NULL").count() == 1 and files.care(g).count() == 1
    d = g.where("type = 'Car'").withColumn("score", F.lit(0.5))
    files.write_detections(d, str(tmp_path / "out"))
    text = [p.read_text() for p in (tmp_path / "out").rglob("part-*") if "frame=3" in str(p)]
    assert len("".join(text).split()) == 16
    e = files.evaluable(d).first()
    assert e.image and e.ground and e.orientation


def test_calibration_and_frame(spark, tmp_path):
    (tmp_path / "000003.txt").write_text("P2: " + " ".join(map(str, range(12))) + "\nR0_rect: " + " ".join(["1"] * 9) + "\nTr_velo_to_cam: " + " ".join(["2"] * 12) + "\n")
    c = files.read_calibration(spark, str(tmp_path))
    r = c.first()
    assert (r.frame, len(r.p), len(r.r_rect), len(r.t_cv)) == (3, 12, 9, 12)
    scans = spark.createDataFrame([(3, 0, 1.0)], "frame int, hit_idx int, x double")
    labels = spark.createDataFrame([(3, "Car"), (3, "Van")], "frame int, type string")
    assert len(files.read_frame(scans, labels, c).first().labels) == 2


def test_tracklets(spark, tmp_path):
    item = "<item><tx>1.5</tx><ty>2</ty><tz>0</tz><rx>0</rx><ry>0</ry><rz>0.1</rz><state>2</state><occlusion>0</occlusion></item>"
    (tmp_path / "t.xml").write_text(f"<root><tracklet><objectType>Car</objectType><h>1.5</h><w>1.6</w><l>4</l><first_frame>10</first_frame><poses>{item}{item}</poses><finished>1</finished></tracklet></root>")
    rows = files.read_tracklets(spark, str(tmp_path / "t.xml")).orderBy("frame").collect()
    assert [(r.frame, r.type, r.tx) for r in rows] == [(10, "Car", 1.5), (11, "Car", 1.5)]


def test_laser_log(spark, tmp_path):
    ranges = ["1.0"] * 90 + ["81"] * 90
    (tmp_path / "log").write_text("ODOM 1 2\nFLASER 180 " + " ".join(ranges) + " 0.5 0.25 0.0 1 2 3\n")
    rows = files.read_laser_log(spark, str(tmp_path / "log")).orderBy("beam").collect()
    assert len(rows) == 90 and abs(rows[0].x - 0.5) < 1e-9 and abs(rows[0].y + 0.75) < 1e-9


def test_voxels_and_sparse_grids(spark, tmp_path):
    g = np.random.default_rng(1).random(32**3, dtype=np.float32)
    for name in ("a__0__.df", "a__1__.sdf"):
        (tmp_path / name).write_bytes(b"\0" * 24 + g.tobytes())
    p = files.paired(files.read_voxels(spark, str(tmp_path)))
    assert p.count() == 1 and np.allclose(p.first().full, g)
    cells, lo = np.array([[0, 1, 2], [15, -16, 0], [99, 0, 0]]), np.array([0.5, -2.0, 1.0])
    (tmp_path / "b.sog").write_bytes(files.sparse_grid_bytes(cells, lo, 0.3))
    rows = sorted((r.i, r.j, r.k, r.sign) for r in files.read_sparse_grids(spark, str(tmp_path)).collect())
    assert rows == [(0, 1, 2, 1), (15, -16, 0, -1)]


def test_grids_by_class(spark, tmp_path):
    g = spark.createDataFrame([("Car", 1, 0.5), ("Van", 2, -0.1)], "class string, i int, log_odds double")
    files.save_grids(g, str(tmp_path / "g"), ["class"])
    assert [r.i for r in files.load_grids(spark, str(tmp_path / "g"), ["Van"]).collect()] == [2]
    files.write_csv(g, str(tmp_path / "c"))
    assert files.read_csv(spark, str(tmp_path / "c"), "c string, i int, v double").count() == 2
