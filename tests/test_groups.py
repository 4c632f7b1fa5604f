"""Groups that workers take together, and what this spares: an exchange with a worker for each group, sides that pass through the driver."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prismara.operators import faces, morphology
from prismara.operators.groups import whole
from prismara.plans import catalog, fixtures

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size", [1, 3, 10_000])
def test_groups_are_whole_whatever_batches_are(spark, size):
    df = spark.range(200).select((F.col("id") % 17).alias("k"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("n"), F.col("id") % 3)).alias("t"), F.when(F.col("id") % 5 > 0, F.lit(0.5)).otherwise(F.lit("NaN").cast("double")).alias("d"), "id")

    def work(rows, starts):
        of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        ids = np.asarray(rows.column("id"))
        yield pa.RecordBatch.from_arrays([pa.array([ids[of == g].tolist() for g in range(len(starts) - 1)])], names=["ids"])

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        got = sorted(r.ids for r in whole(df, ["k", "t", "d"], work, "ids array<long>", ["id"]).collect())
        assert whole(df.limit(0), ["k"], work, "ids array<long>").count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == sorted(sorted(i for i in range(200) if (i % 17, i % 3, i % 5 > 0) == k) for k in {(i % 17, i % 3, i % 5 > 0) for i in range(200)})


@pytest.mark.parametrize("name", ["knn9", "rbf_weights", "seed_window_components", "center_component"])
def test_lenses_share_calls_of_workers(spark, name):
    found = plan(catalog.QUERIES[name](spark, SF))
    assert "MapInArrow" in found and "GroupsInArrow" not in found and "InMemoryTableScan" not in found


def test_components_over_small_batches(spark):
    image = spark.createDataFrame([(k, v, u, 255 * ((u * 7 + v * 13 + u * v + k) % 5 < 2)) for k in range(6) for v in range(12) for u in range(9)], "k int, v int, u int, val int")
    want = {tuple(r) for r in morphology.labelled(image, ["k"], 100).collect()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        assert {tuple(r) for r in morphology.labelled(image, ["k"], 3).collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_points_do_not_pass_through_the_driver(spark):
    r = faces.recipe(catalog._some_ties(spark, fixtures.LENS.scaled(24), 8), 8, 24)
    found = plan(faces.recipe_by_columns(r, catalog._some_ties(spark, fixtures.LENS.scaled(24), 8), 24))
    assert "Join" in found and "BroadcastHashJoin" not in found


def test_weights_by_columns_shuffle_no_neighbours(spark):
    found = {name: plan(catalog.QUERIES[name](spark, SF)) for name in ("rbf_weights", "rbf_weights_by_columns")}
    assert "Join" not in found["rbf_weights_by_columns"] and "collect_list" not in found["rbf_weights_by_columns"]
    assert found["rbf_weights_by_columns"].count("Exchange") == found["rbf_weights"].count("Exchange")


@pytest.mark.parametrize("margins", [faces.MARGINS, (2, 4)])
def test_neighbours_with_places_give_the_same_weights(spark, margins):
    ties = catalog._some_ties(spark, fixtures.LENS.scaled(24), 10).persist()
    rows = lambda df: {(r.face, r.row, r.col): r for r in df.collect()}
    solved, placed = (faces.recipe(ties, 10, 24, everywhere=True, margins=margins, solve=x) for x in (True, False))
    want, got = rows(solved), rows(placed)
    assert placed.columns == ["face", "row", "col", "src", "d2", "px", "py"] and set(got) == set(want) and len(want) == 500
    assert all(got[k].src == want[k].src and got[k].d2 == want[k].d2 and np.allclose((np.array(r.px) - r.col) ** 2 + (np.array(r.py) - r.row) ** 2, r.d2) for k, r in got.items())
    here, looked_up = rows(faces.recipe_by_columns(placed, None, None)), rows(faces.recipe_by_columns(solved, ties, 24))
    assert here == looked_up and set(here) == {k for k, r in want.items() if r.d2[0] <= faces.REACH**2}
    assert all(r.src == want[k].src and np.allclose(r.w, want[k].w, atol=1e-6) for k, r in here.items())
    ties.unpersist()


@pytest.mark.parametrize("name", ["knn9", "rbf_weights", "rbf_weights_by_columns"])
def test_points_of_small_lenses_are_not_shuffled(spark, name):
    found = plan(catalog.QUERIES[name](spark, SF)).splitlines()
    assert any("Exchange" in x for x in found) and not any("Exchange" in x and "face" in x for x in found)


def test_groups_are_shuffled_only_if_they_are_not_dealt_already(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("a"), (F.col("id") % 3).alias("b"), "id")
    alike = lambda rows, starts: [pa.RecordBatch.from_arrays([pa.array(np.diff(starts)), rows.column("a").take(pa.array(starts[:-1]))], names=["n", "a"])]
    for dealt, exchanges in ((df, 1), (df.repartition(3, "a"), 1), (df.repartition(3, "id"), 2)):
        got = whole(dealt, ["a", "b"], alike, "n long, a long")
        assert plan(got).count("Exchange") == exchanges
        assert sorted((r.a, r.n) for r in got.collect()) == sorted((a, sum(i % 7 == a and i % 3 == b for i in range(100))) for a in range(7) for b in range(3))


def test_bands_of_a_lens_can_share_a_task(spark):
    from prismara.sources import grid

    table = spark.createDataFrame([(k, 3, 40) for k in range(9)], "lens_id int, width int, height int")
    table = table.withColumns({c: F.lit(0.0) for c in grid.PARAMETERS if c not in table.columns})
    for together in (False, True):
        px = grid.lens_pixels(table, ["lens_id"], band=4, together=together).select("lens_id", F.spark_partition_id().alias("task"))
        tasks = px.groupBy("lens_id").agg(F.countDistinct("task").alias("n"), F.count(F.lit(1)).alias("pixels")).collect()
        assert {r.pixels for r in tasks} == {120} and len(tasks) == 9 and (max(r.n for r in tasks) == 1) == together
