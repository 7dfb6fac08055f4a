"""What plans look like: pruning reaches the scan, nothing is shuffled without need, workers find the package."""

import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

import tesserae
from tesserae.functions.grid import Grid
from tesserae.operators import pixels as P
from tesserae.plans.selection import Request, ordered


def plan_of(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("frames") / "f.parquet")
    table = tesserae.frames(np.arange(3 * 64 * 64, dtype=np.int32).reshape(3, 64, 64), 16, spark=spark)
    table.df.drop("payload").withColumn("spare", F.lit("x" * 50)).write.parquet(path)
    return spark.read.parquet(path), table.grid


def test_a_window_prunes_the_scan(stored):
    frames, grid = stored
    plan = plan_of(P.place(frames, Request.of(grid, b=[2, 0, 2], y=(20, 30), x=(0, 40))))
    pushed = plan[plan.index("PushedFilters") :].split("\n")[0]
    for part in ("GreaterThanOrEqual(row,1)", "LessThan(row,2)", "LessThan(col,3)", "In(band, [0,2])"):
        assert part in pushed
    schema = plan[plan.index("ReadSchema") :].split("\n")[0]
    assert "spare" not in schema and "frame_index" not in schema
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_selections_do_not_shuffle(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    few = ordered(df, "k", [5, 3, 5], "place")
    assert "Exchange" not in plan_of(few)
    assert sorted(map(tuple, few.collect())) == [(3, 1), (5, 0), (5, 2)]
    many = [i % 90 for i in range(300)]
    got = ordered(df, "k", many, "place")
    assert sorted(map(tuple, got.collect())) == sorted((k, i) for i, k in enumerate(many))
    assert "SortMergeJoin" not in plan_of(got)


def test_an_index_has_rows_for_the_window_only(spark):
    grid = Grid(4, 1 << 20, 1 << 20, 256, 256)  # 67 million frames
    found = Request.of(grid, b=[1], y=(1000, 1300), x=(0, 300)).frames(spark)
    assert found.count() == 3 * 2
    assert found.agg(F.min("frame_index")).first()[0] == 3 * 4096 * 4 + 1


def test_workers_find_the_package_from_anywhere(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(tesserae.__file__)))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from tesserae.operators import header as H
from tesserae.functions.grid import Grid
blob = H.encode_header(Grid(1, 4, 4, 4, 4), [9])
print("FRAMES", H.parsed(spark.createDataFrame([(bytearray(blob),)], "header binary"), strict=True).first().parsed.frames)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "FRAMES 1" in out.stdout, out.stderr[-2000:]
