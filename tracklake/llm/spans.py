"""Substring removal by sliding spans of sentences.

A text is cut after sentence ends and line ends; so that very long sentences also take
part, it is cut after words chosen by their hash too, which places the cuts the same way
wherever a passage stands.  From every sentence the shortest run of at least
``MIN_SENTENCES`` sentences and ``MIN_WORDS`` words is hashed.  Runs meet in one global
aggregate (count and smallest doc_id), and a sentence is removed when any run that
covers it is not the first of its kind: the first stands in the document with the
smallest doc_id, at its first place there.  White space between words does not matter.

The rule ``WHOLE``, which the query and the pipeline use, is finer.  A run counts by words
alone, one word in four ends a piece, a sentence may end in symbols after its mark, and a
piece of more than ``LONG_PIECE`` words is also cut where a word's hash is the smallest near
it, so that repeated words have cuts.  The shortest run that ends at each piece is hashed
too, so that a shared passage, and an exact copy, is covered up to its last piece.

Hashes that occur once are dropped by the aggregate, which combines on the map side, so
a passage in a third of all documents is no hot key; the join with the repeated hashes
has one row per hash on one side and can be split.  Before it a bit table of the repeated
hashes, of bounded size, leaves out most of the others.

Defined results: a null text stays null, a text without a repeated run is returned byte
for byte; rows that repeat doc_id and text count as one document and stay alike; a row
with a null doc_id only loses what repeats inside its own text; a text that loses all
sentences becomes empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carry, fresh, map_batches, materialize
from .hashing import _BASE, _INVERSE, Words, mixed, powers, sums_of_runs, words_of

MIN_SENTENCES = 3
MIN_WORDS = 20
#: One word in so many ends a piece of its own.
CUT_EVERY = 12
#: Pieces of a run, its words, one word in so many as a cut, and ``whole``.
WHOLE = (1, MIN_WORDS, 4, True)
#: Words a piece may have before it is cut at smallest hashes, and how far on each side they are the smallest.
LONG_PIECE = 16
NEAR = 8
#: Bits of the table of repeated hashes: so many for each, within bounds (powers of two).
BITS_EACH = 16
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27


@dataclass(slots=True)
class Spans:
    """Sentences of a run of texts and the runs of them that begin at each."""

    text_of: np.ndarray  # text of each sentence
    byte_start: np.ndarray  # where each sentence begins
    begins: np.ndarray  # sentences at which a span begins, its last sentence and its hash
    last: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # whether it is the first span with this hash in its text


def _sentence_ends(w: Words) -> np.ndarray:
    """Words with a sentence mark after their last letter or digit."""
    place = np.arange(len(w.data))
    mark = np.isin(w.data, np.frombuffer(b".!?", dtype=np.uint8))
    letter = (w.data >= 128) | np.isin(w.data, np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", dtype=np.uint8))
    last_mark = np.maximum.accumulate(np.where(mark, place, -1))[w.end - 1]
    last_letter = np.maximum.accumulate(np.where(letter, place, -1))[w.end - 1]
    return last_mark >= np.maximum(w.start, last_letter)


def _cut_long(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``ends`` and, in pieces of more than ``LONG_PIECE`` words, the words with the smallest hash of those near them in the piece."""
    piece = np.concatenate([[0], np.cumsum(ends)[:-1]])
    at = np.flatnonzero((np.bincount(piece) > LONG_PIECE)[piece])
    own, piece = h[at], piece[at]
    smallest = np.ones(len(at), dtype=bool)
    for d in range(1, min(NEAR, len(at) - 1) + 1):
        apart = piece[d:] != piece[:-d]
        smallest[d:] &= apart | (own[d:] <= own[:-d])
        smallest[:-d] &= apart | (own[:-d] <= own[d:])
    ends[at[smallest]] = True
    return ends


def spans_of(w: Words, min_sentences: int, min_words: int, cut_every: int, whole: bool) -> Spans:
    n = len(w.start)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Spans(none, none, none, none, none.astype(np.uint64), none.astype(bool))
    lines = np.concatenate([[0], np.cumsum(w.data == 10)])
    ends = _sentence_ends(w) if whole else np.isin(w.data[w.end - 1], np.frombuffer(b".!?", dtype=np.uint8))
    ends |= (w.hash >> np.uint64(20)) % np.uint64(cut_every) == 0
    ends[:-1] |= lines[w.start[1:]] > lines[w.end[:-1]]
    ends[w.bounds[1:][w.bounds[1:] > 0] - 1] = True
    if whole:
        ends = _cut_long(w.hash, ends)
    first_word = np.concatenate([[0], np.flatnonzero(ends)[:-1] + 1])
    own = mixed(sums_of_runs(w.hash, first_word))
    text_of = np.searchsorted(w.bounds, first_word, side="right") - 1
    k = len(own)
    upto = np.append(first_word[1:], n)  # words up to the end of each sentence
    at = np.arange(k)
    last = np.maximum(at + min_sentences - 1, np.searchsorted(upto, first_word + min_words))
    inside = last < k
    inside[inside] = text_of[last[inside]] == text_of[inside]
    if whole:
        begin = np.minimum(at - min_sentences + 1, np.searchsorted(first_word, upto - min_words, side="right") - 1)
        ends_here = begin >= 0
        ends_here[ends_here] = (text_of[begin[ends_here]] == text_of[ends_here]) & (last[begin[ends_here]] != at[ends_here])
        at, last = np.concatenate([at[inside], begin[ends_here]]), np.concatenate([last[inside], at[ends_here]])
    else:
        at, last = at[inside], last[inside]
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(own * powers(k)[:k], dtype=np.uint64)])
    value = mixed((sums[last + 1] - sums[at]) * powers(k, _INVERSE)[at] + _BASE * (last - at).astype(np.uint64))
    order = np.lexsort((at, value, text_of[at]))
    again = np.zeros(len(at), dtype=bool)
    again[order[1:]] = (value[order[1:]] == value[order[:-1]]) & (text_of[at[order[1:]]] == text_of[at[order[:-1]]])
    return Spans(text_of, w.start[first_word], at, last, value, ~again)


def _runs(column: pa.Array, options: tuple[int, int, int, bool]) -> Iterator[tuple[Words, Spans]]:
    for w in words_of(column, lower=False):
        yield w, spans_of(w, *options)


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("of"))


def repeated(docs: DataFrame, options: tuple[int, int, int, bool]) -> DataFrame:
    """span, first_doc of the spans that stand in more than one row."""

    def work(batch: pa.RecordBatch, _) -> dict | None:
        ids, rows, hashes = batch.column(0), [], []
        for w, s in _runs(batch.column(1), options):
            rows.append(w.first_text + s.text_of[s.begins[s.first]])
            hashes.append(s.hash[s.first])
        return {"span": np.concatenate(hashes).view(np.int64), "doc_id": ids.take(pa.array(np.concatenate(rows)))} if rows else None

    spans = map_batches(_rows(docs), work, "span long, doc_id long")
    return spans.groupBy("span").agg(F.count(F.lit(1)).alias("_n"), F.min("doc_id").alias("first_doc")).filter("_n > 1").drop("_n")


def _bit_table(known: DataFrame) -> np.ndarray:
    """A bit for the low digits of each hash of ``known``, in words of 64."""
    bits = LEAST_BITS
    while bits < min(MOST_BITS, BITS_EACH * known.count()):
        bits *= 2
    at = F.col("span").bitwiseAND(F.lit(bits - 1).cast("long"))
    rows = known.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast((span & {bits - 1}L) & 63L as int))").alias("bit"))
    got = rows.groupBy("word").agg(F.bit_or("bit").alias("set")).toArrow()
    table = np.zeros(bits // 64, dtype=np.uint64)
    table[got.column("word").to_numpy()] = got.column("set").to_numpy().view(np.uint64)
    return table


def later_spans(docs: DataFrame, known: DataFrame, options: tuple[int, int, int, bool]) -> DataFrame:
    """doc_id, of, spans: first and last sentence of the spans that an earlier document has."""
    sent = docs.sparkSession.sparkContext.broadcast(_bit_table(known))

    def work(batch: pa.RecordBatch, _) -> dict | None:
        table = sent.value
        rows, hashes, begins, last = [], [], [], []
        for w, s in _runs(batch.column(1), options):
            low = s.hash & np.uint64(64 * len(table) - 1)
            use = s.first & ((table[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1) == 1)
            text = s.text_of[s.begins[use]]
            rows.append(w.first_text + text)
            hashes.append(s.hash[use])
            start = np.searchsorted(s.text_of, text)
            begins.append(s.begins[use] - start)
            last.append(s.last[use] - start)
        if not rows:
            return None
        take = pa.array(np.concatenate(rows))
        return {"span": np.concatenate(hashes).view(np.int64), "doc_id": batch.column(0).take(take), "of": batch.column(2).take(take),
                "begins": np.concatenate(begins).astype(np.int32), "last": np.concatenate(last).astype(np.int32)}

    spans = map_batches(_rows(docs), work, "span long, doc_id long, of long, begins int, last int")
    met = spans.join(known, "span").filter(F.col("doc_id") > F.col("first_doc"))
    # the spans of one document are as many as its sentences
    return met.groupBy("doc_id", "of").agg(F.collect_list(F.struct("begins", "last")).alias("spans"))


def _thinned(docs: DataFrame, min_sentences: int, min_words: int, cut_every: int, whole: bool) -> tuple[DataFrame, dict]:
    """thinned, n_sentences and n_removed beside the carried columns of ``docs``."""
    options = (min_sentences, min_words, cut_every, whole)
    found = fresh(docs.columns, "_spans")
    later = later_spans(docs, materialize(repeated(docs, options)), options).select(F.col("doc_id").alias("_id"), F.col("of").alias("_of"), F.col("spans").alias(found))
    same = (docs["doc_id"].cast("long") == later["_id"]) & (F.xxhash64(docs["text"].cast("string")) == later["_of"])
    joined = docs.join(later, same, "left").select(*[docs[c] for c in docs.columns], later[found])

    def work(batch: pa.RecordBatch, _) -> dict:
        column, spans = batch.column(0), batch.column(1)
        row = np.repeat(np.arange(len(column)), pc.list_value_length(spans).fill_null(0).to_numpy(zero_copy_only=False))
        flat = spans.flatten()
        begins, last = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        texts, sentences, removed = column.to_pylist(), [0] * len(column), [0] * len(column)
        for w, s in _runs(column, options):
            gone = np.zeros(len(s.text_of) + 1, dtype=np.int64)
            own = ~s.first
            np.add.at(gone, s.begins[own], 1)
            np.add.at(gone, s.last[own] + 1, -1)
            bounds = np.searchsorted(s.text_of, np.arange(w.texts + 1))
            own = slice(*np.searchsorted(row, [w.first_text, w.first_text + w.texts]))
            start = bounds[row[own] - w.first_text]
            np.add.at(gone, start + begins[own], 1)
            np.add.at(gone, start + last[own] + 1, -1)
            gone = np.cumsum(gone)[:-1] > 0
            lengths = np.diff(bounds)
            for t in np.flatnonzero(lengths):
                a, b = bounds[t], bounds[t + 1]
                sentences[w.first_text + t] = int(b - a)
                if not gone[a:b].any():
                    continue
                removed[w.first_text + t] = int(gone[a:b].sum())
                # a text ends before the first sentence of the next text that has any
                stop = w.text_end[t]
                edge = np.append(s.byte_start[a:b], stop)
                keep = np.flatnonzero(~gone[a:b])
                texts[w.first_text + t] = b"".join(w.data[edge[i] : edge[i + 1]].tobytes() for i in keep).decode().strip()
        return {"thinned": texts, "n_sentences": sentences, "n_removed": removed}

    frame, own = carry(joined, ["text", found], work, "thinned string, n_sentences long, n_removed long")
    del own[found]
    return frame, own


def without_repeats(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, cut_every: int = CUT_EVERY, whole: bool = False) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, ...) with ``text`` thinned, and n_sentences and n_removed, which replace columns of that name."""
    frame, own = _thinned(docs, min_sentences, min_words, cut_every, whole)
    kept = [F.col("thinned").alias("text") if c == "text" else x for c, x in own.items() if c not in ("n_sentences", "n_removed")]
    return frame.select(*kept, "n_sentences", "n_removed")


def thinned(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, cut_every: int = CUT_EVERY, whole: bool = False) -> DataFrame:
    """``docs`` with thinned texts and ``n_chars`` counted anew, without the documents that lost all of their text."""
    frame, own = _thinned(docs, min_sentences, min_words, cut_every, whole)
    own |= {"text": F.col("thinned").alias("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length("thinned").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return frame.filter((F.col("n_removed") == 0) | (F.col("thinned") != "")).select(*own.values())
