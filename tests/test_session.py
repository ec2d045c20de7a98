"""The folder for written tables."""

from __future__ import annotations

from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tideline import session
from tideline.operators.modelling import side_by_side


def test_written_tables_are_recorded_and_removed(spark):
    folder = Path(session.shared_folder(spark).removeprefix("file:")) / "tideline"
    before = set(folder.iterdir()) if folder.exists() else set()
    held, session._written = session._written, {}
    try:
        kept = session.materialise(spark.range(10))
        assert kept.count() == 10 and len(set(folder.iterdir()) - before) == 1
        assert session.release(spark) == 1
        assert set(folder.iterdir()) == before
        assert session.release(spark) == 0
    finally:
        session._written = held


def test_a_cluster_without_the_setting_is_an_error():
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]"):
        cluster = SimpleNamespace(
            sparkContext=SimpleNamespace(applicationId=f"none-{master}", master=master),
            conf=SimpleNamespace(get=lambda key, default=None: default),
        )
        session.ready(cluster)
        with pytest.raises(RuntimeError):
            session.shared_folder(cluster)


def test_discard_removes_one_table(spark):
    kept, gone = session.materialise(spark.range(3)), session.materialise(spark.range(5))
    path = gone.inputFiles()[0].removeprefix("file://").removeprefix("file:")
    assert Path(path).exists()
    session.discard(gone)
    assert not Path(path).exists() and kept.count() == 3


def test_a_frame_can_be_written_and_read_again(spark):
    """Shuffle files of a write are removed; the frame itself still works."""
    grouped = spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()
    assert session.materialise(grouped).count() == grouped.count() == len(grouped.collect()) == 7
    assert spark.conf.get(session.CLEANUP) == "false"


def test_writes_side_by_side_leave_the_setting_as_it_was(spark):
    frames = side_by_side({str(n): lambda n=n: session.materialise(spark.range(n)) for n in range(1, 7)})
    assert {name: frame.count() for name, frame in frames.items()} == {str(n): n for n in range(1, 7)}
    assert spark.conf.get(session.CLEANUP) == "false"


def test_python_gets_few_rows_at_once(spark):
    """A bound on batches holds for one write, and never raises a lower one."""

    def sizes(batches):
        for batch in batches:
            yield batch.assign(id=len(batch))

    frame = spark.range(100, numPartitions=1).mapInPandas(sizes, "id long")
    before = spark.conf.get(session.BATCH_ROWS)
    assert {r.id for r in session.materialise(frame, 10).collect()} == {10}
    assert {r.id for r in session.materialise(frame).collect()} == {100}
    assert spark.conf.get(session.BATCH_ROWS) == before
