"""Sizes over the ranges of the suffix filter: one byte each, also where a range holds more than a byte can say."""

from __future__ import annotations

import random

import numpy as np

from tracklake.llm import jaccard


def long_texts() -> list[tuple[int, str]]:
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**9)}" for _ in range(45_000)]
    near = [f"x{i}" if i % 100 == 0 else w for i, w in enumerate(base)]
    far = [f"y{i}" if i % 20 == 0 else w for i, w in enumerate(base)]
    return [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, "a short text of some words")]


def test_a_range_takes_one_byte(spark):
    docs = spark.createDataFrame(long_texts(), "doc_id long, text string")
    levels = spark.sparkContext.broadcast(np.zeros(1024, dtype=np.uint8))
    parts = jaccard.signatures(docs, 3, 90, levels).select("parts").toArrow().column(0).combine_chunks().values
    assert len(parts) == 4 * jaccard.PARTS and parts.nbytes == len(parts)
    assert 0 <= np.min(parts.to_numpy()) and np.max(parts.to_numpy()) == 127


def test_full_ranges_lose_no_link(spark):
    docs = spark.createDataFrame(long_texts(), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs, 3, 90).collect()}
    # one word in 100 changes 3 % of the shingles, one in 20 changes 15 %
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
