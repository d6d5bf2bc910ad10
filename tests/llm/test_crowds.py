"""A large family of near copies: all links of the brute force, without meeting in all pairs."""

import random

import pytest

from tracklake.llm import jaccard


def family(members: int, words: int) -> list[tuple[int, str]]:
    """Copies of one text with 0 to 20 replaced words, other texts, and exact copies among both."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    rows = []
    for i in range(members):
        own = list(base)
        for at in rng.sample(range(words), min(20, int(rng.expovariate(0.2)))):
            own[at] = f"x{rng.randrange(4000)}"
        rows.append((i, " ".join(own)))
    rows += [(members + i, " ".join(f"v{rng.randrange(900)}" for _ in range(words))) for i in range(20)]
    return rows + [(members + 100 + i, rows[7 * i][1]) for i in range(30)]


def brute(rows: list[tuple[int, str]], n: int, percent: int) -> dict[int, int]:
    sets = {d: {tuple(t.split()[i : i + n]) for i in range(len(t.split()) - n + 1)} for d, t in rows}
    least = {d: d for d in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            shared = len(sets[a] & sets[b])
            if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((find(a), find(b)))
                least[y] = x
    return {d: find(d) for d in sets}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_family_meets_at_its_rare_shingles(spark, monkeypatch, n, percent):
    rows, paired, plain = family(300, 150), [], jaccard.meetings

    def counted(postings, percent):
        pairs = plain(postings, percent)
        paired.append(pairs.count())
        return pairs

    monkeypatch.setattr(jaccard, "meetings", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs, n, percent).collect()}
    assert got == brute(rows, n, percent)
    assert len(paired) == 1 and paired[0] <= 300 * 300 // 16
