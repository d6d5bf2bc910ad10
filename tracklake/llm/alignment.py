"""Alignment of the tokens of two tokenizers over the same bytes.

A text is encoded by both sides and every token becomes a range of bytes.  Per batch, and
keyed by document, ``merge_asof`` gives for each token start of one side the token of the
other side that covers it.  The union of both directions is the set of all overlapping
token pairs (links), and the places where both sides end a token cut a text into groups,
the smallest parts that both sides tokenize alone.

How many documents hold a pair of ids linked is one aggregate over the distinct pairs of
each document.  These counts come back to the documents as sorted arrays that go along
with each task while their number is within ``BROADCAST_PAIRS``; beyond, distinct pairs are
joined with the counts by a shuffle.  Both ways give the same rows.

Defined results: null and empty texts, and texts that one side does not give back byte by
byte, have no tokens (zeros, an empty group string); rows that repeat a doc_id are separate
documents and are counted as such; a null doc_id is kept; an empty table gives no row.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .byte_tokens import ByteTokens, default_ranks
from .common import fits_broadcast, map_batches, materialize

#: Bytes of whole texts that are aligned at once.
CHUNK_BYTES = 1 << 20
#: Up to so many pairs of ids (17 bytes each) go along with every task.
BROADCAST_PAIRS = 4_000_000


class ByteSide:
    """Tokens of a byte-level vocabulary given as ranks; special strings in a text are plain text."""

    def __init__(self, path: str | None = None):
        path = path or default_ranks()
        self.tokens = ByteTokens(path, special={})
        with open(path, "rb") as lines:
            entries = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
        self.bytes_of = [entries.get(i, b"") for i in range(max(entries) + 1)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(self.tokens.ids(" " + t), dtype="<u4").astype(np.int64) for t in texts]


class PieceSide:
    """Tokens of a sentencepiece model that adds the space before a text itself."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        self.bytes_of = [self._bytes(i) for i in range(self.model.get_piece_size())]

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, dtype=np.int64) for ids in self.model.encode(texts, num_threads=1)]


class _Side:
    """Ids, starts, ends and documents of the tokens of some texts."""

    def __init__(self, ids: list[np.ndarray], lengths: np.ndarray):
        self.sizes = np.array([len(x) for x in ids], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        self.ids = np.concatenate([*ids, np.zeros(0, dtype=np.int64)])
        self.doc = np.repeat(np.arange(len(ids)), self.sizes)
        own = lengths[self.ids]
        self.end = np.cumsum(own)
        self.start = self.end - own

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame({"start": self.start, "doc": self.doc, "at": np.arange(len(self.ids))})


class Aligner:
    """Aligns lists of texts; made once per task."""

    def __init__(self, a, b):
        self.sides = (a, b)
        self.lengths = [np.array([len(x) for x in s.bytes_of], dtype=np.int64) for s in self.sides]
        na, nb = (len(x) for x in self.lengths)
        # how an id is written: inside a list or at its end, per side
        names = [str(i) + mark for n, marks in ((na, ",|"), (nb, ",;")) for mark in marks for i in range(n)]
        self.names, self.offsets = np.array(names, dtype=object), (0, na, 2 * na, 2 * na + nb)

    def encoded(self, texts: list[str]) -> list[list[np.ndarray]]:
        """Ids of both sides per text; none where a side does not give the text back."""
        both = [s.encode(texts) for s in self.sides]
        none = np.zeros(0, dtype=np.int64)
        for d, t in enumerate(texts):
            want = b" " + t.encode()
            if not t or any(b"".join(map(s.bytes_of.__getitem__, ids[d].tolist())) != want for s, ids in zip(self.sides, both)):
                both[0][d] = both[1][d] = none
        return both

    def links(self, a: _Side, b: _Side) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers (of a, of b) of all pairs whose ranges overlap, each once."""
        fa, fb = a.frame(), b.frame()
        over_a = pd.merge_asof(fa[["start", "doc"]], fb, on="start", by="doc")["at"].to_numpy(np.int64)
        over_b = pd.merge_asof(fb[["start", "doc"]], fa, on="start", by="doc")["at"].to_numpy(np.int64)
        later = np.flatnonzero(a.start[over_b] != b.start)  # equal starts are pairs of the first direction already
        return np.concatenate([fa["at"].to_numpy(), over_b[later]]), np.concatenate([over_a, later])

    def align(self, texts: list[str]) -> dict[str, list | np.ndarray]:
        ids_a, ids_b = self.encoded(texts)
        a, b = _Side(ids_a, self.lengths[0]), _Side(ids_b, self.lengths[1])
        n = len(texts)
        if not len(a.ids):
            zero, empty = np.zeros(n, dtype=np.int64), [np.zeros(0, dtype=np.int32)] * n
            return {"n_a": zero, "n_b": zero, "n_groups": zero, "n_links": zero, "groups": [""] * n, "link_a": empty, "link_b": empty, "link_n": empty}
        i, j = self.links(a, b)
        together = a.end[i] == b.end[j]
        ends_a, ends_b = np.zeros(len(a.ids), dtype=bool), np.zeros(len(b.ids), dtype=bool)
        ends_a[i[together]] = True
        ends_b[j[together]] = True
        # distinct pairs of ids per document
        width = len(self.lengths[1])
        pairs = len(self.lengths[0]) * width
        found, times = np.unique(a.doc[i] * pairs + a.ids[i] * width + b.ids[j], return_counts=True)
        cuts = np.searchsorted(found, np.arange(1, n) * pairs)
        pair = found % pairs
        split = {"link_a": pair // width, "link_b": pair % width, "link_n": times}
        return {
            "n_a": a.sizes,
            "n_b": b.sizes,
            "n_groups": np.bincount(a.doc[ends_a], minlength=n),
            "n_links": np.bincount(a.doc[i], minlength=n),
            "groups": self.written(a, b, ends_a, ends_b),
            **{name: np.split(x.astype(np.int32), cuts) for name, x in split.items()},
        }

    def written(self, a: _Side, b: _Side, ends_a: np.ndarray, ends_b: np.ndarray) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` per text: ids of both sides, group by group."""
        group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
        first_a = np.concatenate([[0], np.flatnonzero(ends_a) + 1])
        first_b = np.concatenate([[0], np.flatnonzero(ends_b) + 1])
        code = np.empty(len(a.ids) + len(b.ids), dtype=np.int64)
        code[np.arange(len(a.ids)) + first_b[group_a]] = a.ids + np.where(ends_a, self.offsets[1], self.offsets[0])
        code[np.arange(len(b.ids)) + first_a[group_b + 1]] = b.ids + np.where(ends_b, self.offsets[3], self.offsets[2])
        names = self.names[code].tolist()
        cuts = (a.first + b.first).tolist()
        return ["".join(names[x:y])[:-1] for x, y in zip(cuts, cuts[1:])]


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    """Runs of whole texts of about ``CHUNK_BYTES``."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= CHUNK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


_FIELDS = "n_a long, n_b long, n_groups long, n_links long, groups string, link_a array<int>, link_b array<int>, link_n array<int>"


def align(docs: DataFrame, a: Callable = ByteSide, b: Callable = PieceSide) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): numbers of tokens, groups and links, the groups as text, and the distinct
    linked pairs of ids with how often each occurs."""

    def work(batch: pa.RecordBatch, aligner: Aligner) -> dict:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        out = {name: [] for name in (f.split()[0] for f in _FIELDS.split(", "))}
        for chunk in _chunks(texts):
            for name, values in aligner.align(chunk).items():
                out[name].extend(values)
        return out | {"doc_id": batch.column(0)}

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(rows, work, f"doc_id long, {_FIELDS}", lambda: Aligner(a(), b()))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, n (documents that hold the pair linked) and whether n is the highest of its a."""
    pairs = aligned.select(F.explode(F.arrays_zip("link_a", "link_b")).alias("p")).select(F.col("p.link_a").alias("a"), F.col("p.link_b").alias("b"))
    counts = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    # an id has at most as many partners as the other side has ids
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))


def scored(aligned: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``aligned`` (a written table) with n_best and count_sum in place of its pairs."""
    counts = materialize(pair_counts(aligned))
    if fits_broadcast(counts, broadcast_pairs):
        return _scored_by_arrays(aligned, counts)
    return _scored_by_join(aligned, counts)


def _scored_by_arrays(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    known = counts.toArrow()  # at most ``BROADCAST_PAIRS`` rows
    a, b, n, best = (known.column(c).to_numpy() for c in ("a", "b", "n", "best"))
    width = int(b.max(initial=0)) + 1
    order = np.argsort(a.astype(np.int64) * width + b)
    shared = aligned.sparkSession.sparkContext.broadcast(((a.astype(np.int64) * width + b)[order], n[order], best[order].astype(np.int64)))
    kept = [c for c in aligned.columns if not c.startswith("link_")]

    def work(batch: pa.RecordBatch, _) -> dict:
        pairs, count, top = shared.value
        x, y, times = (batch.column(c) for c in ("link_a", "link_b", "link_n"))
        first = np.concatenate([[0], np.cumsum(np.diff(x.offsets.to_numpy()))])
        key = x.flatten().to_numpy().astype(np.int64) * width + y.flatten().to_numpy()
        at = np.searchsorted(pairs, key)
        weight = times.flatten().to_numpy().astype(np.int64)
        totals = [np.concatenate([[0], np.cumsum(weight * v[at])]) if len(at) else np.zeros(1, dtype=np.int64) for v in (top, count)]
        sums = {name: t[first[1:]] - t[first[:-1]] for name, t in zip(("n_best", "count_sum"), totals)}
        return {c: batch.column(c) for c in kept} | sums

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.schema if f.name in kept)
    return map_batches(aligned, work, f"{ddl}, n_best long, count_sum long")


def _scored_by_join(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """The same by a shuffle of distinct pairs; adaptive execution splits the pairs that most documents have."""
    rows = materialize(aligned.withColumn("_row", F.monotonically_increasing_id()))
    zipped = F.explode(F.arrays_zip("link_a", "link_b", "link_n")).alias("p")
    pairs = rows.select("_row", zipped).select("_row", F.col("p.link_a").alias("a"), F.col("p.link_b").alias("b"), F.col("p.link_n").alias("times"))
    best = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best")
    sums = pairs.join(counts, ["a", "b"]).groupBy("_row").agg(best, F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    joined = rows.drop("link_a", "link_b", "link_n").join(sums, "_row", "left").drop("_row")
    return joined.fillna(0, ["n_best", "count_sum"])
