"""Packing token sequences by minimum bin slack.

Each document becomes token ids and is cut into full windows and one remainder.  Only
the histogram of remainder lengths (at most ``window - 1`` numbers, whatever the size
of the corpus) is planned centrally: for the longest length left, a subset-sum bitset
over the multiset of the other lengths finds the fill closest to the window, the
counts are read back from the bitsets, and the pattern is used as often as the counts
allow.  Pieces then take their place in the patterns by their rank among pieces of
equal length.

Defined results: a null text counts as empty and gives one piece (the closing id
alone); repeated rows are separate documents; an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .byte_tokens import ByteTokens
from .common import map_batches, materialize

WINDOW = 2048
END_ID = 1
#: Pieces of one length are ranked in so many groups, so that a frequent length is no single task.
RANK_GROUPS = 512

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces_of(ids: bytes, window: int = WINDOW) -> Iterable[tuple[int, int, int]]:
    """(start, length, crc32) of the pieces of one document given as 32-bit ids."""
    total = len(ids) // 4
    for start in range(0, total, window):
        part = ids[4 * start : 4 * (start + window)]
        yield start, len(part) // 4, zlib.crc32(part)


def cut(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, ranks_path: str | None = None) -> DataFrame:
    """Pieces of all documents (doc_id, text): full windows and one remainder each."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def work(batch: pa.RecordBatch, tokens: ByteTokens) -> dict:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = tokens.ids(text or "") + end
            rows.extend((doc_id, start, length, crc, len(ids) // 4) for start, length, crc in pieces_of(ids, window))
        return dict(zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens"), zip(*rows)))

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), work, PIECES, lambda: ByteTokens(ranks_path))


def _fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """Numbers of each length whose sum is closest to ``room`` without passing it."""
    full, reach = 1 << room, 1
    mask = (full << 1) - 1
    steps: list[tuple[int, int, int]] = []  # (length, copies, sums reachable before the step)
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left and not reach & full:
            copies = min(copies, left)
            steps.append((length, copies, reach))
            reach |= (reach << (length * copies)) & mask
            left -= copies
            copies *= 2
        if reach & full:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, copies, before in reversed(steps):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + copies
            total -= length * copies
    return taken


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """Patterns (numbers of each length) and how often each is used; every piece is used once."""
    left, out = {x: n for x, n in histogram.items() if n}, []
    while left:
        seed = max(left)
        rest = dict(left)
        rest[seed] -= 1
        pattern = _fill({x: n for x, n in rest.items() if n}, window - seed)
        pattern[seed] = pattern.get(seed, 0) + 1
        times = min(left[x] // need for x, need in pattern.items())
        for x, need in pattern.items():
            left[x] -= need * times
            if not left[x]:
                del left[x]
        out.append((pattern, times))
    return out


def _places(patterns: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For each length and pattern: first rank, copies per sequence, first sequence, offset; sorted by (length, rank)."""
    rows, sequence, used = [], 0, {}
    for pattern, times in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            rows.append((length, used.get(length, 0), pattern[length], sequence, offset))
            used[length] = used.get(length, 0) + pattern[length] * times
            offset += pattern[length] * length
        sequence += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "copies", "sequence", "offset"), table.T))


def ranked(pieces: DataFrame) -> DataFrame:
    """0-based ``rank`` of each piece among pieces of its length, in a fixed order."""
    group = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(RANK_GROUPS)).cast("int")
    dealt = pieces.withColumn("_group", group)
    sizes = dealt.groupBy("length", "_group").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("length", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("length", "_group").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    numbered = dealt.withColumn("_at", F.row_number().over(inside) - 1)
    return numbered.join(first, ["length", "_group"]).withColumn("rank", F.col("_first") + F.col("_at")).drop("_group", "_first", "_at")


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, ranks_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = materialize(cut(docs, window, end_id, ranks_path))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``window`` rows
    shared = docs.sparkSession.sparkContext.broadcast(_places(plan(histogram, window)))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def place(batch: pa.RecordBatch, _) -> dict:
        known = shared.value
        length, rank = (batch.column(i).to_numpy() for i in (2, 5))
        # position in the table sorted by (length, rank): first by length, then among its few ranks
        low = np.searchsorted(known["length"], length, side="left")
        high = np.searchsorted(known["length"], length, side="right")
        at = np.empty(len(length), dtype=np.int64)
        for a, b in set(zip(low.tolist(), high.tolist())):
            own = (low == a) & (high == b)
            at[own] = a + np.searchsorted(known["rank"][a:b], rank[own], side="right") - 1
        step = rank - known["rank"][at]
        copies = known["copies"][at]
        placed = {"sequence_id": known["sequence"][at] + step // copies, "offset": known["offset"][at] + step % copies * length}
        return {c: batch.column(i) for i, c in enumerate(columns)} | placed

    return map_batches(ranked(pieces).select(*columns, "rank"), place, f"{PIECES}, sequence_id long, offset long")
