"""Datasets: versions, compaction, storage, subsets and validators."""

import pytest

from sparkmat.sources import dataset as S


def test_versions_and_storage(spark, tmp_path):
    path = f"file://{tmp_path}/data"
    d = S.Dataset(spark, path)
    cells = spark.range(20).withColumnRenamed("id", "cell")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (5, 19, 2.0)], "src long, dst long, weight double")
    d.put(obs=cells.repartition(4), obsp__network=edges)
    stale = S.Dataset(spark, path)
    d.compact(["obs"], codec="none")
    info = {r.name: r for r in d.storage().collect()}
    assert info["obs"].files == 1 and info["obs"].codec == "none" and info["obsp/network"].codec == "snappy"
    assert d["obs"].count() == 20 and stale["obs"].count() == 20
    with pytest.raises(RuntimeError):
        stale.put(uns={"late": 1})
    assert "late" not in S.Dataset(spark, path).index["uns"]
    d.subset(cells.where("cell < 3"))
    again = S.Dataset(spark, path)
    assert again["obs"].count() == 3 and again["obsp/network"].count() == 2
    with pytest.raises(ValueError):
        d.subset(cells.where("cell > 50"))


def test_validators(spark):
    cells = spark.range(3).withColumnRenamed("id", "cell")
    S.check_rows(cells, cells, "cell", "obsm/x")
    with pytest.raises(ValueError):
        S.check_rows(cells.union(cells.limit(1)), cells, "cell", "obsm/x")
    with pytest.raises(ValueError):
        S.check_pairs(spark.createDataFrame([(0, 7, 1.0)], "src long, dst long, weight double"), cells, "cell")


def test_lines_keep_their_order(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("".join(f"n{i % 90}\t{i}\n" for i in range(100)))
    rows = S.read_annotations(spark, f"file://{tmp_path}/t.tsv").orderBy("pos").collect()
    assert [r.V2 for r in rows] == [str(i) for i in range(100)] and rows[90].name == "n0_1"
