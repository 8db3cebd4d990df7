import pytest

from helpers import land
from tickloom.session import scratch_dir
from tickloom.sources import kafka_options, read_files, read_kafka


def test_kafka_options():
    assert kafka_options("b:9092", "stock_analysis") == {
        "kafka.bootstrap.servers": "b:9092",
        "subscribe": "stock_analysis",
        "startingOffsets": "earliest",
        "failOnDataLoss": "false",
    }
    more = kafka_options("b", "t", "latest", True, 64, 1000)
    assert (more["failOnDataLoss"], more["minPartitions"], more["maxOffsetsPerTrigger"]) == (
        "true",
        "64",
        "1000",
    )


def test_kafka_package_is_asked_for(spark):
    """The connector is not part of PySpark; Spark says which package to add."""
    with pytest.raises(Exception, match="(?i)kafka"):
        read_kafka(spark, kafka_options("b:9092", "t"))


def test_files_by_line_or_whole(spark, tmp_path):
    land(str(tmp_path / "run=1"), ["a", "b"], "x.txt")
    land(str(tmp_path / "run=2"), ["c"], "y.txt")
    path = f"{tmp_path}/run=*"
    lines = read_files(spark, path, stream=False)
    assert lines.columns == ["value"]
    assert sorted(r.value for r in lines.collect()) == ["a", "b", "c"]
    whole = read_files(spark, path, stream=False, whole_files=True)
    assert sorted(r.value for r in whole.collect()) == ["a\nb\n", "c\n"]
    assert read_files(spark, path).isStreaming


def test_scratch_is_in_the_shared_folder(spark, tmp_path):
    before = spark.conf.get("spark.checkpoint.dir", None)
    first, second = scratch_dir(spark, "x"), scratch_dir(spark, "x")
    assert first != second
    if before:
        assert first.startswith(before)
