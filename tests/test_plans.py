"""Plans: no Python where built-in functions suffice, pruned scans, few exchanges."""

import re

import pytest

from perceptra import catalog

from .oracle import SMALL

PYTHON = re.compile(r"ArrowEvalPython|BatchEvalPython|MapInPandas|MapInArrow|FlatMapGroupsInPandas|PythonUDF")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["occ_grid", "occ_grid_posed_boxed", "joint_model", "voxel_moments_blur27", "pose_log_odds", "nms_local_max", "ray_histogram_2gram", "histogram_percentile", "pr_curve", "iou_pairs", "kernel_features", "point_in_box_label"])
def test_no_python(spark, name):
    assert not PYTHON.search(plan(catalog.QUERIES[name](spark, SMALL)))


def test_a_grid_needs_one_exchange_and_three_columns(spark):
    p = plan(catalog.QUERIES["occ_grid_posed_boxed"](spark, SMALL))
    assert len(re.findall(r"Exchange ", p)) == 1 and "Window" not in p
    assert re.search(r"ReadSchema: struct<vec_id:bigint,embedding:array<float>>", p)


def test_no_nested_loops_over_frames(spark):
    for name in ("iou_pairs", "anti_join_too_close", "point_in_box_label", "interval_join_active"):
        assert not re.search("NestedLoop|Cartesian", plan(catalog.QUERIES[name](spark, SMALL)))
