import re

import pytest
from pyspark.sql import functions as F

from surfacelab.operators import mesh as M
from surfacelab.operators import rounds as G
from surfacelab.plans import catalogue


def broadcasts(df):
    return len(re.findall("BroadcastExchange", df._jdf.queryExecution().executedPlan().toString()))


@pytest.mark.parametrize("name", ["q_bands", "q_refine", "q_estimate_frame", "q_nearest", "q_orient"])
def test_what_is_made_of_a_small_file_isnt_taken_for_small(spark, sf_dir, name):
    # Vectors of a few MB are hundreds of times as many voxels: no join may collect them in the driver.
    assert broadcasts(catalogue.QUERIES[name](spark, sf_dir)) == 0


def test_joins_of_rounds_and_of_what_a_semi_join_left_are_shuffled(spark):
    rows = G.cut(spark.range(50).select(F.col("id").alias("mesh"), *[(F.col("id") % k).alias(n) for n, k in (("fid", 5), ("a", 7), ("b", 11), ("c", 13))]))
    assert broadcasts(rows.join(rows.select("mesh", F.col("fid").alias("other")), "mesh")) == 0
    assert broadcasts(M.remove_nonmanifold(rows, 2)) == 0


@pytest.mark.parametrize("name, slow", [("q_ink_tiles", "FlatMapGroups"), ("q_sheet_normals", "FlatMapGroups"), ("q_isosurface", "lambdafunction")])
def test_no_call_of_python_or_lambda_for_each_group(spark, sf_dir, name, slow):
    """Tiles, grids and tetrahedra are many and small: a call of Python for each, or interpreted functions of arrays, take most of the time."""
    plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert slow not in plan
