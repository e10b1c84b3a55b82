"""Layers and versioned tables."""

import threading

import pytest
from pyspark.sql import functions as F

from rowkin.sources.tables import Layers, PublishConflict, VersionedTables, rename_if_absent


def test_of_two_publishers_one_wins(spark, tmp_path):
    tables = VersionedTables(spark, str(tmp_path / "gold"))
    for turn in range(50):
        start, won, lost = threading.Barrier(2), [], []

        def publish(version):
            start.wait()
            try:
                tables.publish(version, ["t"], seq=turn + 1)
                won.append(version)
            except PublishConflict:
                lost.append(version)

        threads = [threading.Thread(target=publish, args=(f"v{turn}{side}",)) for side in "ab"]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        assert len(won) == len(lost) == 1
        assert tables.current_version("t") == won[0]
    assert tables.last_seq() == 50


def test_commits_aside_are_not_read(spark, tmp_path):
    tables = VersionedTables(spark, str(tmp_path))
    assert tables.read("t") is None and tables.last_seq() == 0
    tables.write("v1", "t", spark.range(3))
    tables.publish("v1", ["t"])
    with pytest.raises(PublishConflict):
        tables.publish("v2", ["t"], seq=1)
    assert tables.last_seq() == 1 and tables.read("t").count() == 3


def test_rename_if_absent_keeps_what_is_there(spark, tmp_path):
    for name in ("a b", "c"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f").write_text(name)
    assert rename_if_absent(spark, f"file:{tmp_path}/a%20b", str(tmp_path / "d"))
    assert not rename_if_absent(spark, str(tmp_path / "c"), str(tmp_path / "d"))
    assert (tmp_path / "d" / "f").read_text() == "a b" and (tmp_path / "c" / "f").exists()
    with pytest.raises(FileNotFoundError):
        rename_if_absent(spark, str(tmp_path / "none"), str(tmp_path / "e"))


def test_append_merges_columns_by_name(spark, tmp_path):
    layers = Layers(spark, str(tmp_path))
    layers.append("ops", "t", spark.createDataFrame([(1, "x")], "id bigint, Name string"))
    layers.append("ops", "t", spark.createDataFrame([("y", 2)], "name string, id bigint"))
    layers.append("ops", "t", spark.createDataFrame([(3,)], "id bigint"))
    got = layers.append("ops", "t", spark.createDataFrame([(4, 0.5)], "id bigint, extra double"))
    assert sorted(got.columns) == ["Name", "extra", "id"]
    assert sorted((r.id, r.Name, r.extra) for r in got.collect()) == [(1, "x", None), (2, "y", None), (3, None, None), (4, None, 0.5)]
    with pytest.raises(ValueError, match="id: string for bigint"):
        layers.append("ops", "t", spark.createDataFrame([("5",)], "id string"))
    assert layers.read("ops", "t", merge=True).count() == 4
    layers.append("ops", "t", got.limit(0))
    assert layers.read("ops", "t", merge=True).agg(F.count("*")).first()[0] == 4
