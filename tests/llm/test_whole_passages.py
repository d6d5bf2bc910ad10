"""What op3 and the pipeline's stage remove of passages that an earlier document has."""

import random

import corpus_pipeline
from tracklake.llm import queries

from .conftest import WORDS


def sentence(rng, n):
    """Words without a hash in common with other sentences, ended by a full stop."""
    return " ".join(f"{rng.choice(WORDS)}{rng.randrange(10**6)}" for _ in range(n)) + "."


def both(spark, tmp_path, data):
    """doc_id -> text by op3 and by the stage."""
    df = spark.createDataFrame(data, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    query = {r["doc_id"]: r["text"] for r in queries.QUERIES["op3_spans"](spark, str(tmp_path)).collect()}
    return query, {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_spans(spark, df, str(tmp_path)).collect()}


def test_exact_copies_lose_their_last_word(spark, tmp_path):
    rng = random.Random(4)
    lengths = [(25, 5, 5, 3), *([rng.randrange(3, 9) for _ in range(rng.randrange(8, 14))] for _ in range(30))]
    texts = [" ".join(sentence(rng, n) for n in own) for own in lengths]
    data = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(texts)]
    query, stage = both(spark, tmp_path, data)
    assert all(query[i] == t == stage[i] for i, t in enumerate(texts))
    assert {i: query[100 + i] for i in range(len(texts)) if query[100 + i]} == {}
    assert set(stage) == set(range(len(texts)))


def planted(n, draws, seed):
    """(doc_id, text) of pairs that share ``n`` words in the middle of a line, and those words."""
    rng = random.Random(seed)
    data, shared = [], []
    for i in range(draws):
        passage = sentence(rng, n)[:-1]
        if i % 4 == 1:  # marks hidden by symbols
            passage = " ".join(x + ".&&&" * (k % 11 == 10) for k, x in enumerate(passage.split()))
        if i % 4 == 2:  # two words in turn
            passage = " ".join(passage.split()[k % 2] for k in range(n))
        for j in (0, 1):
            data.append((1000 * j + i, f"{sentence(rng, 70)[:-1]} {passage} {sentence(rng, 70)[:-1]}"))
        shared.append(passage.split())
    return data, shared


def test_passages_inside_a_line(spark, tmp_path):
    data, shared = planted(51, 120, 6)
    query, stage = both(spark, tmp_path, data)
    texts = dict(data)
    left = []
    for i, passage in enumerate(shared):
        assert query[i] == texts[i] == stage[i] or i % 4 == 2
        assert query[1000 + i] == stage[1000 + i]
        own = set(query[1000 + i].split())
        assert own >= set(texts[1000 + i].split()) - set(passage)  # nothing of its own is lost
        if i % 4 != 2:
            left.append(sum(x in own for x in passage))
        else:
            left.append(sum(x in passage[:2] for x in query[1000 + i].split()))
    assert sum(n > 31 for n in left) <= 1, left  # not found
    assert sum(left) / len(left) < 9, left
