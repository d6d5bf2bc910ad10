"""Tables of a sketch: the right cells at every size, and work that follows the digests."""

from __future__ import annotations

import time
from functools import reduce
from operator import xor

import pytest
from pyspark.sql import functions as F

from tracklake.llm import sketches


@pytest.mark.parametrize("size", [8, 32, 128, 2048])
def test_cells_hold_the_digests_whose_bits_name_them(spark, size):
    df = spark.range(300).select(F.xxhash64("id").alias("x")).agg(F.collect_list("x").alias("keys"))
    keys, cells = df.select("keys", sketches.cells(F.col("keys"), size).alias("cells")).first()
    assert len(cells) == 3 * size
    for table in range(3):
        for at in range(size):
            own = [k for k in keys if ((k % (1 << 64)) >> (20 * table)) & (size - 1) == at]
            cell = cells[table * size + at]
            assert (cell["n"], cell["key"]) == (len(own), reduce(xor, own, 0))


def test_large_tables_do_not_compare_every_digest_with_every_cell(spark):
    sets = spark.range(60, numPartitions=1).select(F.transform(F.sequence(F.lit(1), F.lit(1024)), lambda i: F.xxhash64(i, "id")).alias("keys")).cache()
    sets.count()

    def seconds(size: int) -> float:
        def run() -> float:
            start = time.time()
            sets.select(F.size(F.filter(sketches.cells(F.col("keys"), size), lambda c: c["n"] > 0)).alias("n")).agg(F.sum("n")).collect()
            return time.time() - start

        return min(run() for _ in range(2))

    # 128 times as many cells
    assert seconds(1024) < 12 * seconds(8)
    sets.unpersist()
