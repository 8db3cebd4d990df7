"""Suffix dedup: packs, anchors that many stretches share, and the time to sort suffixes."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from test_llm import brute_repeats, by_key
from tickloom.llm import repeats


def prose(rng, n):
    return " ".join("".join(rng.choice("abdeinorst") for _ in range(rng.randint(2, 7))) for _ in range(n))


def shard_of(texts):
    raw = [t.encode() for t in texts]
    values = (
        np.arange(len(raw), dtype=np.int64).tobytes(),
        np.array([len(x) for x in raw], dtype=np.int64).tobytes(),
        repeats.squeeze(np.frombuffer(b"".join(raw), dtype=np.uint8)),
    )
    arrays = [pa.array([0], pa.int64()), *(pa.array([x], pa.binary()) for x in values)]
    return pa.RecordBatch.from_arrays(arrays, ["shard", "ids", "sizes", "body"])


def test_a_shard_sends_its_packs_in_one_batch():
    rng = random.Random(1)
    texts = [prose(rng, 300) for _ in range(40)]
    shard = shard_of(texts + texts)
    for buckets in (8, 64):
        sent = list(repeats._send_anchors(iter([shard]), 50, buckets))
        assert [batch.num_rows for batch in sent] == [buckets]
        packs = pa.Table.from_batches(sent)
        marks = pa.concat_tables(repeats._answer_anchors(packs.slice(i, 1), 9, 999) for i in range(buckets))
        answers = pa.concat_arrays(marks.select(["bucket", "flags"]).to_struct_array().chunks)
        lists = pa.ListArray.from_arrays(pa.array([0, len(answers)], pa.int32()), answers)
        given = pa.RecordBatch.from_arrays([*shard.columns, lists], [*shard.schema.names, "answers"])
        assert [batch.num_rows for batch in repeats._send_stretches(iter([given]), 50, buckets)] == [buckets]


def test_suffixes_are_sorted_in_time():
    rng = np.random.default_rng(2)
    raw = b"a phrase that is in every text; ".join(bytes(rng.integers(97, 101, 40).astype(np.uint8)) for _ in range(3000))
    data = np.frombuffer(raw, dtype=np.uint8)
    starts = np.arange(len(data) - 50)
    began = time.process_time()
    plain = sorted(starts.tolist(), key=lambda k: raw[k : k + 50])
    took = time.process_time() - began
    began = time.process_time()
    order = repeats.suffix_order(repeats.HashedText(data), starts, np.zeros(len(starts), dtype=np.int64), 50)
    assert time.process_time() - began < 3 * took + 0.5
    assert order.tolist() == plain


@pytest.mark.parametrize("hot_stretches", [32, 1 << 18])
def test_many_stretches_under_one_anchor(spark, hot_stretches):
    rng = random.Random(3)
    phrase = "a phrase of some length; "
    ends = [prose(rng, 12) for _ in range(30)]
    rows = [(i, rng.choice(ends) + phrase + rng.choice(ends) + rng.choice(ends)[:20] + prose(rng, 5)) for i in range(400)]
    rows += [(1000, phrase.join(ends) * 2), (None, rows[7][1]), (7, rows[300][1])]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = repeats.remove_repeats(docs, shard_bytes=8000, hot_stretches=hot_stretches).select(
        "doc_id", "n_bytes", F.col("n_bytes") - F.octet_length("kept"), F.size("spans"), F.sha2("kept", 256)
    )
    assert by_key(found.collect()) == brute_repeats(rows)


def test_short_texts_make_full_shards(spark):
    texts = spark.range(4000, numPartitions=1).select("id", F.lit("some thirty bytes of text, each").alias("text"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        shards = texts.mapInArrow(lambda it: repeats._cut(it, 50_000), repeats._SHARDS).count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert shards == 3
