"""Operators on texts against plain Python."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tracklake.llm import hashing, jaccard, language, mixing, packing, sketches, spans, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return (t or "").encode().lower().split()


def collect(df):
    return [r.asDict() for r in df.collect()]


# hashes

@pytest.mark.parametrize("run_bytes", [1 << 20, 9, 1])
def test_words_and_shingles(rows, run_bytes, monkeypatch):
    monkeypatch.setattr(hashing, "RUN_BYTES", run_bytes)
    texts = [r[1][:3000] if r[1] else r[1] for r in rows]
    seen, sets = {}, {}
    for w in hashing.words_of(pa.array(texts), lower=True):
        for t in range(w.texts):
            a, b = w.bounds[t], w.bounds[t + 1]
            own = [w.data[s:e].tobytes().lower() for s, e in zip(w.start[a:b], w.end[a:b])]
            assert own == words(texts[w.first_text + t])
            for x, h in zip(own, w.hash[a:b]):
                assert seen.setdefault(x, h) == h
        for t, found in hashing.distinct_shingles(w, 3):
            own = words(texts[t])
            want = frozenset(tuple(own[i : i + 3]) for i in range(len(own) - 2)) or (frozenset([tuple(own)]) if own else frozenset())
            assert len(want) == len(found)
            assert sets.setdefault(want, found.tolist()) == found.tolist()
    assert len(set(seen.values())) == len(seen)


# near duplicates

def brute_components(rows, n, percent):
    sets = []
    for _, t, *_ in rows:
        own = words(t)
        sets.append({tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if len(own) >= n else {tuple(own)} if own else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = []
    for g in groups.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        out += [(rows[i][0], len(sets[i]), min(ids) if ids else None) for i in g]
    return sorted(out, key=str), list(groups.values())


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80), (2, 50)])
def test_near_duplicates(docs, rows, n, percent):
    got = jaccard.near_duplicates(docs, n, percent, slots=1 << 10)
    assert sorted(map(tuple, got.collect()), key=str) == brute_components(rows, n, percent)[0]


def test_near_duplicates_of_a_large_family(spark):
    """Chains and stars of near copies: linked only over others, with frequent shingles in common."""
    base = [f"w{i}" for i in range(60)]
    data = []
    for i in range(150):
        own = list(base)
        for k in range(i % 7):
            own[(i * 13 + k * 17) % 60] = f"x{i}{k}"
        data.append((i, " ".join(own)))
    data += [(1000 + i, " ".join(f"y{i}z{k}" for k in range(20)) + " common words that many have") for i in range(50)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(7)
    for percent in (90, 80, 60):
        got = jaccard.near_duplicates(df, 3, percent, slots=1 << 10)
        assert sorted(map(tuple, got.collect()), key=str) == brute_components(data, 3, percent)[0]


def test_one_of_each(docs, rows, empty):
    got = collect(jaccard.one_of_each(docs, 5, 80))
    _, groups = brute_components(rows, 5, 80)
    with_words = [g for g in groups if words(rows[g[0]][1])]
    assert len(got) == len(with_words) + sum(not words(r[1]) for r in rows)
    assert set(got[0]) == set(docs.columns) and all(r["_n"] == 3 for r in got)
    assert jaccard.one_of_each(empty, 5, 80).count() == 0
    assert jaccard.near_duplicates(empty, 5, 80).count() == 0


def test_prefix_and_required():
    for percent in (50, 80, 90):
        for x in range(1, 60):
            for y in range(x, 60):
                need = jaccard.required(x, y, percent)
                assert 100 * need >= percent * (x + y - need)
                assert need == 0 or 100 * (need - 1) < percent * (x + y - need + 1)
            assert jaccard.prefix_length(x, percent) == x - -(-percent * x // 100) + 1


# spans

def brute_spans(rows, min_sentences=3, min_words=20, cut_every=12):
    cut = []
    for doc, t, *_ in rows:
        raw = (t or "").encode()
        at = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0d]+", raw)]
        hashes = np.concatenate([w.hash for w in hashing.words_of(pa.array([t or ""]), lower=False)])
        sentences, own = [], []
        for i, (a, b) in enumerate(at):
            own.append(i)
            line = i + 1 < len(at) and b"\n" in raw[b : at[i + 1][0]]
            if raw[b - 1 : b] in (b".", b"!", b"?") or (int(hashes[i]) >> 20) % cut_every == 0 or line or i + 1 == len(at):
                sentences.append(own)
                own = []
        spans_ = []
        for a in range(len(sentences)):
            n = 0
            for b in range(a, len(sentences)):
                n += len(sentences[b])
                if b - a + 1 >= min_sentences and n >= min_words:
                    spans_.append((a, b, tuple(tuple(raw[at[i][0] : at[i][1]] for i in s) for s in sentences[a : b + 1])))
                    break
        cut.append((doc, t, raw, at, sentences, spans_))
    first = {}
    for doc, *_, own in cut:
        for _, _, k in own:
            if doc is not None:
                first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, t, raw, at, sentences, own in cut:
        gone, seen = set(), set()
        for a, b, k in own:
            if k in seen or doc is not None and first[k] < doc:
                gone |= set(range(a, b + 1))
            seen.add(k)
        edges = [at[s[0]][0] for s in sentences] + [len(raw)]
        left = b"".join(raw[edges[i] : edges[i + 1]] for i in range(len(sentences)) if i not in gone).decode().strip() if gone else t
        out.append((doc, left, len(sentences), len(gone)))
    return sorted(out, key=str)


def test_spans(docs, rows, empty):
    got = spans.without_repeats(docs).select("doc_id", "text", "n_sentences", "n_removed")
    assert sorted(map(tuple, got.collect()), key=str) == brute_spans(rows)
    assert spans.without_repeats(empty).count() == 0


def test_spans_keep_columns_and_shared_passage(docs, rows):
    got = collect(spans.thinned(docs))
    assert set(got[0]) == set(docs.columns) and {r["n_removed"] for r in got} == {5}
    assert all(r["n_chars"] == len(r["text"]) for r in got if r["text"] is not None)
    assert {101, 102, 103}.isdisjoint(r["doc_id"] for r in got)  # copies of an earlier document lose all
    n = 50
    windows = Counter(w for r in got for w in {tuple(words(r["text"])[i : i + n]) for i in range(len(words(r["text"])) - n + 1)} if r["doc_id"] != 200)
    assert max(windows.values()) == 1


# language

def test_language(spark, docs, empty):
    made = {"en": "the and of that with this from which there where ", "de": "der und die nicht werden eine auch nach über für ", "fr": "les des une dans pour que est sur avec aux "}
    rng = np.random.default_rng(1)
    data = []
    for i in range(300):
        lang = ("en", "de", "fr")[i % 3]
        data.append((i, " ".join(rng.choice(made[lang].split(), int(rng.integers(5, 60)))), lang))
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)
    got = {r["doc_id"]: r for r in collect(language.identify(df))}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in got if got[i]["held_out"]} == set(held)
    assert np.mean([got[i]["lang_pred"] == data[i][2] for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_edges(docs, rows, empty):
    got = defaultdict(list)
    for r in collect(language.identify(docs)):
        got[r["doc_id"]].append(r)
    for i in (130, 131, 132, 135):
        assert got[i][0]["lang_pred"] == "und" and got[i][0]["score"] == 0
    assert got[133][0]["lang_pred"] in ("en", "de", "fr")
    kept = collect(language.keep_identified(docs))
    assert set(kept[0]) == set(docs.columns) and all(r["rejected"] == 2 for r in kept)
    assert {r["doc_id"] for r in kept} == {r[0] for r in rows} - {130, 131, 132, 135} - {r["doc_id"] for x in got.values() for r in x if r["rejected"]}
    assert language.identify(empty).count() == 0
    unlabelled = docs.withColumn("lang", docs["lang"].substr(1, 0)).replace("", None, "lang")
    assert {r["lang_pred"] for r in collect(language.identify(unlabelled))} == {"und"}


# token counts

def best_segmentation(text, pieces, byte_score):
    best = [(0.0, 0)] + [None] * len(text)
    for end in range(1, len(text) + 1):
        size = len(text[end - 1].encode())
        options = [(best[end - 1][0] + size * byte_score, -(best[end - 1][1] + size))]
        for start in range(end):
            if text[start:end] in pieces:
                options.append((best[start][0] + pieces[text[start:end]], -(best[start][1] + 1)))
        score, number = max(options)
        best[end] = (score, -number)
    return best[-1][1]


@pytest.mark.parametrize("nodes", [800_000, 50])
def test_token_counts(docs, rows, empty, nodes):
    pieces, byte_score = token_counts.load_pieces()
    short = [r for r in rows if len(r[1] or "") < 5000]
    got = {(r["doc_id"], r["n_pretokens"], r["n_tokens"]) for r in collect(token_counts.count_tokens(docs, most_nodes=nodes)) if r["doc_id"] not in (136, 137)}
    known = {}

    def count(w):
        if w not in known:
            known[w] = best_segmentation("▁" + w, pieces, byte_score)
        return known[w]

    want = {(r[0], len(WORD.findall(r[1] or "")), sum(count(w) for w in WORD.findall(r[1] or ""))) for r in short}
    assert got == want
    assert token_counts.count_tokens(empty).count() == 0


# packing

@pytest.mark.parametrize("window", [64, 2048])
def test_packing(docs, rows, empty, window):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    extra = [(900, "a  b", None, None), (901, " \n x\n\n y \t z ", None, None), (902, "a\n \nb   c d", None, None), (903, "x <|endoftext|> y", None, None)]
    from pyspark.sql import functions as F

    more = docs.sparkSession.createDataFrame(extra, "doc_id long, text string, lang string, source string")
    both = docs.select(*more.columns).union(more).filter(F.coalesce(F.length("text"), F.lit(0)) < 30_000)
    ids = defaultdict(list)
    for r in rows + extra:
        if len(r[1] or "") < 30_000:
            ids[r[0]].append(np.array(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1], dtype="<u4"))
    got = collect(packing.pack(both, window=window))
    covered = defaultdict(int)
    for r in got:
        assert any(len(a) == r["doc_tokens"] and zlib.crc32(a[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for a in ids[r["doc_id"]])
        covered[r["doc_id"]] += r["length"]
    assert covered == {k: sum(map(len, v)) for k, v in ids.items()}
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    assert packing.pack(empty).count() == 0


def test_plan_fills_windows():
    rng = np.random.default_rng(0)
    for window, n, most in ((50, 400, 1.06), (2048, 3000, 1.02)):
        histogram = Counter(int(x) for x in rng.integers(1, window, n))
        patterns = packing.plan(dict(histogram), window)
        used = Counter()
        for pattern, times in patterns:
            assert sum(x * k for x, k in pattern.items()) <= window
            for x, k in pattern.items():
                used[x] += k * times
        assert used == histogram
        total = sum(x * k for x, k in histogram.items())
        assert sum(t for _, t in patterns) <= total / window * most + 1


def test_fill_is_the_best_subset_sum():
    rng = np.random.default_rng(2)
    for _ in range(200):
        counts = {int(x): int(rng.integers(1, 3)) for x in rng.integers(1, 30, 4)}
        room = int(rng.integers(1, 60))
        reach = {0}
        for x, n in counts.items():
            for _ in range(n):
                reach |= {s + x for s in reach if s + x <= room}
        found = packing._fill(counts, room)
        assert sum(x * n for x, n in found.items()) == max(reach) and all(n <= counts[x] for x, n in found.items())


# mixing

def water_fill(sizes, share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    rest, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / total > most * sizes[s]}
        if not over:
            return target | {s: rest * weight[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
        rest -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_mixing(docs, rows, empty):
    sized = mixing.sizes(docs)
    mixed = mixing.mix(sized, shards=4, block_words=64)
    got = collect(mixing.taken(mixed).join(sized.select("doc_id", "source").distinct(), "doc_id", "left"))
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want, taken = water_fill(sizes), defaultdict(int)
    for r in collect(mixing.taken(mixed)):
        assert r["taken"] <= 2 * r["size"]
    by_source = mixed.selectExpr("source", "target", "source_size", "aggregate(parts, 0L, (n, p) -> n + p.words) taken")
    for r in collect(by_source):
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
    assert {s: taken[s] for s in sizes} == {s: int(want[s] + 1e-9) for s in sizes}
    again = mixing.mix(sized.repartition(2), shards=4, block_words=64)
    assert sorted(map(str, again.select("doc_id", "parts").collect())) == sorted(map(str, mixed.select("doc_id", "parts").collect()))
    assert mixing.taken(mixing.mix(mixing.sizes(empty))).count() == 0


def test_shards_are_disjoint_and_even(docs):
    parts = collect(mixing.shard_parts(mixing.mix(mixing.sizes(docs), shards=4, block_words=64)))
    seen, blocks = set(), defaultdict(int)
    for p in parts:
        assert 0 <= p["shard"] < 4
        if p["doc_id"] not in (None, 200):
            for w in range(p["first"], p["first"] + p["words"]):
                assert (p["doc_id"], p["epoch"], w) not in seen
                seen.add((p["doc_id"], p["epoch"], w))
        blocks[p["shard"]] += p["words"]
    assert max(blocks.values()) < 1.5 * min(blocks.values())


def test_split_tree_is_exact():
    own = np.array([5, 0, 100, 17])
    out = mixing.split_tree(own, 8, 3)
    assert (out.sum(axis=0) == own).all() and out.sum(axis=1).max() - out.sum(axis=1).min() <= 2


def test_mixing_of_more_words_than_the_sampler_takes(spark):
    sizes = {"a": 3 * 10**14, "b": 10**14, None: 7}
    words = mixing.block_size(sum(sizes.values()), len(sizes))
    assert words % mixing.BLOCK_WORDS == 0 and mixing.MOST_EPOCHS * sum(sizes.values()) <= mixing.MOST_BLOCKS * words
    assert mixing.block_size(10**6, 3) == mixing.BLOCK_WORDS
    rows = [(s, n, 1.0) for s, n in sizes.items()]
    sources = mixing.with_targets(spark.createDataFrame(rows, "source string, source_size long, weight double"))
    got = collect(mixing.quotas(sources, shards=16, block_words=words))
    assert {r["source"] for r in got} == set(sizes) and all(r["ends"][-1] == r["draws"] for r in got)
    per_shard = np.diff(np.array([r["ends"] for r in got]), prepend=0, axis=1).sum(axis=0)
    assert per_shard.max() - per_shard.min() <= 1 and sum(r["draws"] for r in got) > 10**8


def test_shards_of_documents_come_from_the_tree(docs, monkeypatch):
    mixed = mixing.mix(mixing.sizes(docs), shards=4, block_words=64)
    held = Counter()
    for r in collect(mixing.taken(mixed)):
        held.update(r["shards"].split(",") if r["shards"] else [])
    parts = {(str(r["shard"]), r["doc_id"]) for r in collect(mixing.shard_parts(mixed))}
    assert set(held) == {"0", "1", "2", "3"} and {s for s, _ in parts} == set(held)
    monkeypatch.setattr(mixing, "_split_left", lambda rng, quotas, draws: np.minimum(quotas, np.maximum(0, draws - (np.cumsum(quotas) - quotas))))
    other = mixing.mix(mixing.sizes(docs), shards=4, block_words=64)
    assert collect(mixing.taken(other).orderBy("doc_id", "size")) != collect(mixing.taken(mixed).orderBy("doc_id", "size"))


def test_mixed_documents(docs, rows, empty):
    got = collect(mixing.mixed_documents(docs, block_words=64))
    assert set(got[0]) == set(docs.columns)
    texts = defaultdict(list)
    for r in rows:
        texts[r[0]].append(r[1] or "")
    for r in got:
        own = [WORD.findall(t) for t in texts[r["doc_id"]]]
        mine = WORD.findall(r["text"])
        assert mine and any(set(mine) <= set(o) and len(mine) <= len(o) for o in own)
        assert r["n_chars"] == len(r["text"])
    assert mixing.mixed_documents(empty).count() == 0


# sketches

def test_sketches(docs, rows, empty):
    import hashlib

    cut = re.compile(r"[^\n]{80,}?[.!?](?= )|[^\n]+")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [r[1] or "" for r in order]
    got = defaultdict(list)
    for r in collect(sketches.compare_edits(docs)):
        got[r["doc_id"]].append(r)

    def same(a, b):
        a, b = set(cut.findall(a)), set(cut.findall(b))
        return 1.0 if a == b else len(a & b) / len(a | b)

    prints = defaultdict(set)
    for i, r in enumerate(order):
        t, follow = texts[i], texts[(i + 1) % len(texts)]
        half = len(t) // 2
        edited = t[: len(t) - half] + follow[:half]
        want = (len(t), hashlib.sha256(edited.encode()).hexdigest(), pytest.approx(same(t, edited)), pytest.approx(same(t, follow)))
        assert any((g["n_chars"], g["edited_sha256"], g["near_edited"], g["near_next"]) == want for g in got[r[0]])
        if r[0] != 200:
            prints[t].add(got[r[0]][0]["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    assert len({next(iter(p)) for p in prints.values()}) >= len(prints) - 2  # texts without a paragraph share the empty one
    assert sketches.compare_edits(empty).count() == 0
    one = collect(sketches.compare_edits(docs.filter("doc_id = 5")))
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_sketch_retries_grow_until_all_is_found(spark):
    a = [f"p{i}" for i in range(600)]
    data = [(0, a, a[:1]), (1, a, [*a[:300], "q"]), (2, a[:3], a[3:40]), (3, [], a[:9]), (4, a, [f"z{i}" for i in range(500)])]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(data, "id long, a array<string>, b array<string>")
    df = df.select("id", *[F.array_sort(F.transform(c, lambda x: F.xxhash64(x))).alias(c) for c in "ab"])
    got = {r["id"]: r["near"] for r in sketches.with_likeness(df, "near", "a", "b").collect()}
    for i, x, y in data:
        assert got[i] == pytest.approx(len(set(x) & set(y)) / len(set(x) | set(y)))
