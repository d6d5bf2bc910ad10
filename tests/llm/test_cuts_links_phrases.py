"""Fill-in-middle, token alignment and phrase search against plain Python."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from tracklake.llm import alignment, fill_middle, postings


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def sorted_rows(rows):
    return sorted(map(tuple, rows), key=str)


# fill in middle


def kinds(places):
    return {c.kind for c in fill_middle.Boundaries.of(places).containers}


@pytest.mark.parametrize("share,kind", [(0.01, fill_middle.ARRAY), (0.4, fill_middle.BITMAP), (0.9999, fill_middle.RUNS)])
def test_boundary_set_selects_every_place(share, kind):
    rng = np.random.default_rng(5)
    places = np.flatnonzero(rng.random(3 * 65_536 + 7700) < share)
    places = places[(places < 65_536) | (places >= 131_072)]  # one block without a place
    held = fill_middle.Boundaries.of(places)
    assert kind in kinds(places) and len(held) == len(places) and held.keys.tolist() == [0, 2, 3]
    assert [held.select(k) for k in range(0, len(places), 97)] == places[::97].tolist()
    assert held.select(len(places) - 1) == places[-1]


def test_boundaries_are_code_points():
    for text in ("", "a", "é", "漢字 😀 ß" * 30_000, "x" * 65_535, "x" * 65_536, "é" + "y" * 70_000 + "漢"):
        held = fill_middle.boundaries(text.encode())
        assert len(held) == len(text) + 1
        for k in {0, len(text) // 3, len(text) // 2, len(text)}:
            assert held.select(k) == len(text[:k].encode())


def brute_cut(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return doc_id, n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_fill_in_middle(spark, docs, rows, empty):
    assert sorted_rows(fill_middle.transform(docs).collect()) == sorted_rows(brute_cut(r[0], r[1]) for r in rows)
    assert fill_middle.transform(empty).count() == 0


def test_restored_from_awkward_texts(spark):
    texts = ["<", "<S", "<<S<M", "P>", "<P>x", "a<M>b", "<P" * 40, "M><S" * 40, "\x00a", "é<" * 500, None, ""]
    data = [(i, t) for i, t in enumerate(texts * 25)]
    made = fill_middle.transform(spark.createDataFrame(data, "doc_id long, text string"))
    back = made.select("doc_id", "form", fill_middle.restored(made["output"], made["form"]).alias("t")).collect()
    assert {r.form for r in back} == {"plain", "psm", "spm"}
    assert {r.doc_id: r.t for r in back} == {i: t or "" for i, t in data}


# alignment of tokens


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_level():
    """The usual table of printable stand-ins for bytes."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(other)}


def brute_alignment(texts, libraries):
    a, b = libraries
    decode = byte_level()
    found = []
    for t in texts:
        sides = []
        if t:
            for tokens in (
                [(i, bytes(decode[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids],
                [(i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()) for i in b.encode(t) for p in [b.id_to_piece(i)]],
            ):
                at, spans = 0, []
                for i, raw in tokens:
                    spans.append((i, at, at + len(raw)))
                    at += len(raw)
                sides.append((b"".join(raw for _, raw in tokens), spans))
        if not t or any(joined != (" " + t).encode() for joined, _ in sides):
            found.append(([], [], [], ""))
            continue
        (_, x), (_, y) = sides
        links, j = [], 0
        for i, s, e in x:
            while y[j][2] <= s:
                j += 1
            k = j
            while k < len(y) and y[k][1] < e:
                links.append((i, y[k][0]))
                k += 1
        ends = sorted({e for *_, e in x} & {e for *_, e in y})
        groups, lo = [], 0
        for hi in ends:
            groups.append("|".join(",".join(str(i) for i, s, e in side if lo <= s and e <= hi) for side in (x, y)))
            lo = hi
        found.append((x, y, links, ";".join(groups)))
    counts = Counter(p for *_, links, _ in found for p in set(links))
    best = {}
    for (i, _), n in counts.items():
        best[i] = max(best.get(i, 0), n)
    return [
        (len(x), len(y), g.count(";") + 1 if g else 0, len(links), g, sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links))
        for x, y, links, g in found
    ]


@pytest.mark.parametrize("broadcast_pairs", [alignment.BROADCAST_PAIRS, 0])
def test_alignment(spark, rows, libraries, broadcast_pairs, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 4000)
    odd = ["▁ already", "<|endoftext|> plain <s></s><unk><0x41>", "  two  spaces  ", " lead", "tail \n\n ", "tab\t\x0bvt", "a\x00b", "﻿bom  nbsp", "é 가ᄀ", "👩‍👩‍👧 🇩🇪", "x", " ", "\r\n"]
    data = [(r[0], r[1][:3000] if r[1] else r[1]) for r in rows] + [(500 + i, t) for i, t in enumerate(odd)]
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = alignment.scored(alignment.materialize(alignment.align(frame)), broadcast_pairs)
    got = got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum").collect()
    want = [(d, *w) for (d, _), w in zip(data, brute_alignment([t for _, t in data], libraries))]
    assert sorted_rows(got) == sorted_rows(want)


def test_alignment_of_nothing(spark, empty):
    aligned = alignment.materialize(alignment.align(empty))
    assert alignment.scored(aligned).count() == alignment.scored(aligned, 0).count() == 0
    nulls = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    rows = alignment.scored(alignment.materialize(alignment.align(nulls))).collect()
    assert {(r.n_a, r.n_links, r.groups, r.n_best, r.count_sum) for r in rows} == {(0, 0, "", 0, 0)}


# phrases

PHRASE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def terms(text):
    return PHRASE.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute_contamination(rows, items, size=10):
    windows = {}
    for item, text in items:
        own = terms(text)
        for i in range(max(len(own) - size + 1, 1) if own else 0):
            windows.setdefault(tuple(own[i : i + size]), set()).add(item)
    out = []
    for doc_id, text in rows:
        own, hit, found = terms(text), set(), set()
        for k in {len(w) for w in windows}:
            for i in range(len(own) - k + 1):
                if tuple(own[i : i + k]) in windows:
                    hit.update(range(i, i + k))
                    found |= windows[tuple(own[i : i + k])]
        out.append((doc_id, len(own), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


def planted(rows):
    own = terms(rows[3][1])
    items = [
        (1, " ".join(own[2:17]).upper()), (2, "; ".join(own[20:26])), (3, own[0]), (4, f"{own[5]} {own[6]}"), (4, " ".join(own[30:45])),
        (5, None), (6, ""), (7, "..."), (8, "never said before in any text of these at all"), (None, " ".join(own[8:19])), (9, "word"),
        (10, "é ß 漢字 é ß 漢字 é ß 漢字 é ß 漢字"), (11, " ".join(own[2:17])), (12, "É ß"), (13, " ".join(own[2:11] + ["else"])),
    ]
    return items


@pytest.mark.parametrize("few", [postings.BROADCAST_TERMS, 0])
def test_contamination(spark, docs, rows, few, monkeypatch):
    monkeypatch.setattr(postings, "BROADCAST_TERMS", few)
    items = planted(rows)
    got = postings.contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    want = brute_contamination([r[:2] for r in rows], items)
    assert sum(w[2] > 0 for w in want) > 8
    assert sorted_rows((r[0], r[1], r[2], list(r[3])) for r in got.collect()) == sorted_rows(want)


def test_contamination_of_nothing(spark, docs, rows, empty):
    items = spark.createDataFrame(planted(rows), "item_id long, text string")
    assert postings.contamination(empty, items).count() == 0
    got = postings.contamination(docs, items.limit(0)).collect()
    assert len(got) == len(rows) and {(r["n_hit"], len(r["items"])) for r in got} == {(0, 0)}


def brute_near(own, window, counts, slop):
    """Starts at which every term stands within ``slop`` of its place, reckoned from the rarest term."""
    rarest = min(range(len(window)), key=lambda i: (counts[window[i]], postings_term(window[i]), i))
    out = set()
    for p, w in enumerate(own):
        if w == window[rarest]:
            start = p - rarest
            if all(any(0 <= q < len(own) and own[q] == x for q in range(start + i - slop, start + i + slop + 1)) for i, x in enumerate(window) if i != rarest):
                out.add(start)
    return out


_HASHES = {}


def postings_term(word):
    return _HASHES[word]


@pytest.mark.parametrize("slop", [0, 1, 2])
def test_proximity(spark, slop):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    pool = [f"w{i}" for i in range(12)]
    texts = [(i, " ".join(rng.choice(pool, 60))) for i in range(30)]
    items = [(1, "w1 w2 w3"), (2, "w4 w4 w5 w6"), (3, "w7 w8"), (4, "w9")]
    _HASHES.update({r.w: r.h for r in spark.createDataFrame([(w,) for w in pool], "w string").select("w", F.xxhash64("w").alias("h")).collect()})
    counts = Counter(w for _, t in texts for w in t.split())
    found, members = postings.search(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), slop=slop)
    got = {(r.doc_id, r.item_id, r.start) for r in found.join(members, "window").collect()}
    want = {(d, item, s) for d, t in texts for item, phrase in items for s in brute_near(t.split(), phrase.split(), counts, slop)}
    assert got == want and len(want) > 50
