"""Runs and conversions as their input arrives."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismara.operators import runlog
from prismara.plans import convert as plan
from prismara.plans import fixtures
from prismara.plans.convert import Options
from prismara.sources import images
from prismara.streaming.runs import run_states
from test_convert import FACE, SIZE, calibration, lens  # noqa: F401

SF = "/root/testdata/sf0.001"
STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(STORE, before)


def test_states_of_runs_equal_the_batch_summary(spark, tmp_path, rocks):
    lines = fixtures.log_lines(spark, SF).where("run < 4")
    for k in range(3):  # a file for each micro-batch
        lines.where(f"line_no div 334 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    (tmp_path / "out").mkdir()
    got = {}

    def keep(df, batch):
        for r in df.collect():
            got[r.run] = r.asDict()

    for _ in range(2):  # the second run of the query has nothing new to tell
        stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        run_states(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    want = {str(r.run): r.asDict() | {"run": str(r.run)} for r in runlog.summary(lines, ("run",)).collect()}
    assert got == want
    assert any(r["pinhole"] and "px" in r["pinhole"] for r in got.values())


def test_lines_behind_the_announcement_are_of_the_cameras(spark):
    lines = ["INFO: x: before", "INFO: x: now set and FIXED for alignment", "INFO: x: f: 8", " plain ", "", "Resolved 3 missing per-image mask(s)", "a: b", "x: y: set and FIXED for alignment again", "[PROGRESS] DONE 1/1: processed=2 skipped=0"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_no int, line string")
    r = runlog.summary(df).first()
    assert r.pinhole.split("\n") == ["f: 8", "plain", "a: b", "set and FIXED for alignment again"] and r.fallback_masks == 3 and r.processed == 2
    assert runlog.summary(df.where("line_no < 1")).first().pinhole is None
    assert "\n\nOutput pinhole camera parameters (set and keep fixed):\n  f: 8\n  plain\n" in runlog.report(runlog.summary(df), "L").first().report
    assert runlog.summary(df.where(F.lit(False)).withColumn("run", F.lit(1)), ("run",)).count() == 0


def files_below(root):
    return {os.path.relpath(os.path.join(d, f), root): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(root) for f in fs if "dir_" in f}


def test_images_are_converted_as_they_arrive(spark, lens, monkeypatch):  # noqa: F811
    root, xml = lens
    o = Options(xml, "L", str(root / "images"), str(root / "out"), masks=str(root / "masks"), face_width=FACE)
    run = lambda: plan.convert_stream(spark, o, str(root / "state"), files_per_batch=1).awaitTermination()
    run()
    first = files_below(root / "out")
    assert len(first) == 20
    (root / "images/c.png").write_bytes(images.png(np.random.default_rng(1).integers(0, 256, (SIZE, SIZE, 3), dtype=np.uint8)))

    # The query is stopped after the files of a batch appeared and before the batch counts as done.
    whole = plan.applied

    def stopped(*args):
        whole(*args)
        raise RuntimeError("stopped")

    monkeypatch.setattr(plan, "applied", stopped)
    with pytest.raises(Exception, match="stopped"):
        run()
    made = files_below(root / "out")
    assert len(made) == 30 and made.items() >= first.items()
    monkeypatch.setattr(plan, "applied", whole)
    run()
    assert files_below(root / "out") == made  # nothing was made twice

    # It is stopped within a batch, before any file appeared.
    (root / "images/d.png").write_bytes((root / "images/c.png").read_bytes())
    real = plan.encoded
    monkeypatch.setattr(plan, "encoded", lambda df, *a: real(df, *a).withColumn("data", F.raise_error(F.lit("stopped")).cast("binary")))
    with pytest.raises(Exception, match="stopped"):
        run()
    assert files_below(root / "out") == made
    monkeypatch.setattr(plan, "encoded", real)
    run()
    assert len(files_below(root / "out")) == 40
