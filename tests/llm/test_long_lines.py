"""Sketches of long lines without a sentence mark before a space."""

import random

from tracklake.llm import queries

from .conftest import WORDS


def test_likeness_of_lines_without_marks(spark, tmp_path):
    rng = random.Random(3)
    words = [f"{rng.choice(WORDS)}{rng.randrange(1000)}" for _ in range(600)]
    chinese = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(3000))
    lines = [" ".join(words), " ".join(w + ".&&&" * (i % 9 == 8) for i, w in enumerate(words)), "word " * 3000, "x" * 5000, chinese]
    # each line is followed by a copy with one more word in front
    data = [(2 * i + j, ("一" if line is chinese else "more ") * j + line) for i, line in enumerate(lines) for j in (0, 1)]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.QUERIES["op1_sketches"](spark, str(tmp_path)).collect()}
    assert min(got[2 * i]["near_next"] for i in (0, 1, 4)) > 0.8, got
    assert all(r["near_edited"] > 0 for r in got.values()), got
