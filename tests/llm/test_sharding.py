import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerstone.llm.sharding import directory, shard


def brute(sizes, limit):
    """The shortest prefix of each key's hash whose bytes fit."""
    bits = {k: bin(int(hashlib.sha256(str(k).encode()).hexdigest()[:15], 16))[2:].zfill(60) for k in sizes}
    total = Counter()
    for k, n in sizes.items():
        for d in range(61):
            total[bits[k][:d]] += n
    return {k: next((bits[k][:d] for d in range(61) if total[bits[k][:d]] <= limit), bits[k]) for k in sizes}


@pytest.mark.parametrize("limit", [1 << 20, 30_000, 4_000])
def test_shards_are_the_shortest_prefixes_that_fit(spark, data, limit):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", F.octet_length("text").cast("long").alias("n"))
    got = shard(rows, ["doc_id"], F.col("n"), limit).collect()
    want = brute({r["doc_id"]: r["n"] for r in got}, limit)
    assert {r["doc_id"]: r["shard"] for r in got} == want
    assert all(r["shard_oversized"] == (r["n"] > limit) for r in got)


def test_rows_of_one_key_go_to_pages_that_fit(spark):
    rows = spark.range(1000, numPartitions=4).select(F.lit(5).alias("k"), F.lit(100).alias("n")).unionByName(spark.range(50).select(F.col("id").alias("k"), F.lit(10).alias("n")))
    got = shard(rows, ["k"], F.col("n"), 1000)
    assert got.count() == 1050
    assert got.groupBy("shard", "shard_page").agg(F.sum("n").alias("s")).agg(F.max("s")).first()[0] <= 1000
    with pytest.raises(ValueError):
        directory(got)


def test_directory_and_edges(spark):
    rows = spark.range(200).select(F.col("id").alias("k"), F.lit(10).alias("n"), F.lit("x").alias("shard_hash"), F.lit(1).alias("_shard_hash"))
    got = shard(rows, ["k"], F.col("n"), 200)
    slots = directory(got).collect()
    depth = max(len(r["slot"]) for r in slots)
    assert len(slots) == len({r["slot"] for r in slots}) == 2**depth and all(r["slot"].startswith(r["shard"]) for r in slots)
    assert shard(rows.limit(0), ["k"], F.col("n"), 200).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, 5), (1, 5000)], "k long, n long")
    assert [r["shard_oversized"] for r in shard(nulls, ["k"], F.col("n"), 1000).orderBy(F.col("n")).collect()] == [False, False, True]
