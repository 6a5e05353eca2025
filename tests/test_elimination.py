"""The elimination job: its log, its result, and going on after it was killed."""

import numpy as np
import pandas as pd
import pytest

from barloom.plans.elimination import EliminationJob, eliminate

FAST = dict(maxDepth=3, maxIter=4)
NAMES = ["a", "b", "noise", "flat"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    n = 900
    pdf = pd.DataFrame(rng.normal(size=(n, 3)), columns=NAMES[:3]).assign(flat=1.0, other="x")
    pdf["fret12"] = 2 * pdf["a"] - pdf["b"] + rng.normal(0, 0.1, n)
    pdf["symbol"], pdf["date"], pdf["interval"] = 1, 20240101 + np.arange(n) // 100, np.arange(n) % 100
    return spark.createDataFrame(pdf)


def rows(job, spark):
    return [tuple(r) for r in job.log(spark).orderBy("n_features").collect()]


def test_the_weakest_go_first(spark, table, tmp_path):
    job = eliminate(table, NAMES, str(tmp_path / "job"), settings=FAST)
    log = rows(job, spark)
    assert [r[0] for r in log] == [1, 2, 3, 4] and [r[2] for r in log] == [None, "b", "noise", "flat"]
    assert set(job.selected(spark)) >= {"a", "b"} and min(r[1] for r in log) == [r for r in log if r[3] == ",".join(job.selected(spark))][0][1]
    reduced = job.reduced(table)
    assert reduced.columns == ["symbol", "date", "interval", *job.selected(spark), "fret12"] and reduced.count() == 900


def test_a_killed_job_goes_on_to_the_same_log(spark, table, tmp_path, monkeypatch):
    whole = rows(eliminate(table, NAMES, str(tmp_path / "whole"), settings=FAST, smallest=2), spark)
    root, first = str(tmp_path / "killed"), EliminationJob.step
    done = []

    def dying(self, spark):
        if done:
            raise KeyboardInterrupt
        done.append(first(self, spark))
        return True

    monkeypatch.setattr(EliminationJob, "step", dying)
    with pytest.raises(KeyboardInterrupt):
        eliminate(table, NAMES, root, settings=FAST, smallest=2)
    monkeypatch.undo()
    (tmp_path / "killed" / "steps" / "0003" / "_temporary").mkdir(parents=True)  # what a step that died in its write leaves
    job = EliminationJob(root, NAMES, settings=FAST, smallest=2)
    assert [r[0] for r in rows(job, spark)] == [4] and job.left(spark) == ["a", "b", "noise"]
    assert rows(eliminate(table, NAMES, root, settings=FAST, smallest=2), spark) == whole
    assert not job.step(spark) and [r[0] for r in whole] == [2, 3, 4]


def test_a_folder_holds_one_job(spark, table, tmp_path):
    EliminationJob(str(tmp_path / "j"), NAMES, settings=FAST).prepare(table)
    with pytest.raises(ValueError, match="another job"):
        EliminationJob(str(tmp_path / "j"), NAMES[:2], settings=FAST).prepare(table)
    with pytest.raises(ValueError, match="no step"):
        EliminationJob(str(tmp_path / "j"), NAMES, settings=FAST).selected(spark)
