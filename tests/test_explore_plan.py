from barloom.plans.explore import Exploration
from barloom.sources.bars import write_by_date
from support import random_bars


def test_one_symbol_over_a_directory(spark, tmp_path):
    bars = spark.createDataFrame(random_bars(symbols=3, days=5, per_day=12))
    root = str(tmp_path / "bars")
    write_by_date(bars, root)
    run = Exploration.of_directory(spark, root, 90000001)
    assert run.data.count() == 60
    assert run.describe().where("column = 'symbol'").first()["std"] == 0
    assert run.info().count() == len(bars.columns)
    assert run.prices().count() == run.volumes().count() == 60
    assert run.histogram().count() == 20 * len(bars.columns)
    assert run.box().count() == 19
    assert not any(r["has_null"] or r["has_inf"] for r in run.check().collect())
    assert run.scores().count() == run.cleaned.count() > 0
    assert run.loadings().columns == ["feature", "PC1", "PC2"]


def test_one_file(spark, tmp_path):
    path = str(tmp_path / "20240103.parquet")
    spark.createDataFrame(random_bars(symbols=2, days=1, per_day=30, gaps=0, infs=0)).drop("date").write.parquet(path)
    run = Exploration.of_file(spark, path, 90000000, fill=False)
    assert {r[0] for r in run.data.select("date").distinct().collect()} == {20240103}
    assert 0 < run.cleaned.count() < 30  # the label is missing at the end, lunch is out
