"""Datasets below a folder, and rows in the order in which their ids are asked for."""

import pytest

from assay.sources import dataset


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    df = spark.range(10)
    for p in ("a/one.parquet", "a/two.json", "a/deep/er/three.orc", ".hidden/four.parquet", "a/_tmp/five.parquet", "b/six.csv"):
        df.write.format(p.rpartition(".")[2]).save(str(root / p))
    (root / "c").mkdir()
    (root / "c" / "town.GPKG").write_bytes(b"x" * 77)
    (root / "c" / "readme.txt").write_text("no table")
    return root


def test_datasets_below_a_folder(spark, tree):
    got = [(d["path"].partition(str(tree))[2].lstrip("/"), d["kind"], d["tables"]) for d in dataset.discover_datasets(spark, str(tree))]
    assert got == [("a", "folder", ["one", "two"]), ("a/deep/er", "folder", ["three"]), ("b", "folder", ["six"]), ("c/town.GPKG", "geopackage", [])]
    size = {d["path"].rpartition("/")[2]: d["bytes"] for d in dataset.discover_datasets(spark, "file://" + str(tree))}
    assert size["town.GPKG"] == 77 and size["b"] == sum(f.stat().st_size for f in (tree / "b" / "six.csv").iterdir() if not f.name.endswith(".crc"))
    assert [d["kind"] for d in dataset.discover_datasets(spark, str(tree / "c" / "town.GPKG"))] == ["geopackage"]
    assert dataset.discover_datasets(spark, str(tree / "gone")) == []


def test_ids_in_the_order_asked_for(spark):
    df = spark.range(100).repartition(7)
    asked = [77, 3, 3, 500, 0, 99, 42, 3, -1]
    ids = spark.createDataFrame([(v, i) for i, v in enumerate(asked)], "id long, pos int").repartition(3)
    assert [r.id for r in dataset.read_ids(df, ids, "id").collect()] == [v for v in asked if 0 <= v < 100]
