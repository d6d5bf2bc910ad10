"""Fill-in-middle: texts cut at two drawn code points and put together in another order.

The places where a text may be cut are the bytes at which a code point begins, and its
end.  They are kept as a compressed set of numbers: blocks of 65,536 bytes, each an array
of 16-bit places, a bitmap, or runs of consecutive places, whichever is smallest, with the
number of places before every block.  The k-th place is found by a search over those
numbers and a local search in one block, so both cuts of a text cost no second pass.

Draws depend on ``seed`` and doc_id alone, so any rerun, on any machine, gives the same
rows.

Defined results: a null text counts as empty and stays plain; a null doc_id is drawn from
the empty string; equal rows give equal rows; a text that holds one of the markers stays
plain; an empty table gives no row; other columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches

# fixed values of the transformation
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PERCENT_CUT = 90
PERCENT_SUFFIX_FIRST = 20
SEED = 1

BLOCK = 1 << 16
ARRAY, BITMAP, RUNS = 0, 1, 2
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.int64)


@dataclass(slots=True)
class Container:
    """Places inside one block of 65,536, held in the smallest of three forms."""

    kind: int
    data: np.ndarray  # ARRAY: places; BITMAP: bytes, lowest place in the highest bit; RUNS: first places
    before: np.ndarray | None = None  # BITMAP: places before each byte; RUNS: places before each run

    @classmethod
    def of(cls, places: np.ndarray) -> Container:
        """The container of ascending places."""
        first = np.flatnonzero(np.diff(places, prepend=-2) != 1)
        in_array, in_runs, in_bitmap = 2 * len(places), 4 * len(first), BLOCK // 8
        if in_runs <= min(in_array, in_bitmap):
            return cls(RUNS, places[first].astype(np.uint16), first)
        if in_array <= in_bitmap:
            return cls(ARRAY, places.astype(np.uint16))
        bits = np.zeros(BLOCK, dtype=np.uint8)
        bits[places] = 1
        data = np.packbits(bits)
        return cls(BITMAP, data, np.cumsum(_BITS[data]) - _BITS[data])

    def select(self, k: int) -> int:
        """The k-th place, counted from 0."""
        if self.kind == ARRAY:
            return int(self.data[k])
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        if self.kind == RUNS:
            return int(self.data[at]) + k - int(self.before[at])
        return 8 * at + int(np.flatnonzero(np.unpackbits(self.data[at : at + 1]))[k - int(self.before[at])])


@dataclass(slots=True)
class Boundaries:
    """The ordered set of places at which a text may be cut."""

    keys: np.ndarray  # block numbers that hold a place
    before: np.ndarray  # places before each of these blocks, and their number in all
    containers: list[Container]

    @classmethod
    def of(cls, places: np.ndarray) -> Boundaries:
        """The set of ascending places (bytes)."""
        block = places >> 16
        first = np.flatnonzero(np.diff(block, prepend=-1))
        ends = np.append(first[1:], len(places))
        return cls(block[first], np.append(first, len(places)), [Container.of(places[a:b] & (BLOCK - 1)) for a, b in zip(first, ends)])

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The k-th place, counted from 0."""
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        return (int(self.keys[at]) << 16) + self.containers[at].select(k - int(self.before[at]))


def boundaries(text: bytes) -> Boundaries:
    """Bytes of a UTF-8 text at which a code point begins, and its end."""
    data = np.frombuffer(text, dtype=np.int8)
    return Boundaries.of(np.append(np.flatnonzero(data >= -64), len(data)))  # bytes 10xxxxxx continue a code point


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


_MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))


def cut_one(text: bytes, h: tuple[int, int, int, int]) -> tuple[int, str, int | None, int | None, bytes]:
    """(code points, form, code points of prefix and middle, output) of one text."""
    places = boundaries(text)
    n = len(places) - 1
    if not n or h[2] % 100 >= PERCENT_CUT or any(m in text for m in _MARKS):
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    i, j = places.select(a), places.select(b)
    p, s, m = _MARKS
    if h[3] % 100 < PERCENT_SUFFIX_FIRST:
        return n, "spm", a, b - a, b"".join((s, text[j:], p, text[:i], m, text[i:j]))
    return n, "psm", a, b - a, b"".join((p, text[:i], s, text[j:], m, text[i:j]))


def transform(docs: DataFrame, seed: int = SEED, draw: Callable = draws) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the transformed text ``output`` for every row of ``docs`` (doc_id, text)."""

    def work(batch: pa.RecordBatch, _) -> dict:
        names = batch.column(0).to_pylist()
        texts = batch.column(1).cast(pa.large_binary()).to_pylist()
        rows = [(name, *cut_one(text or b"", draw(name, seed))) for name, text in zip(names, texts)]
        out = dict(zip(("doc_id", "n", "form", "prefix_chars", "middle_chars", "output"), zip(*rows)))
        return out | {"output": pa.array(out["output"], pa.large_binary()).cast(pa.large_string()).cast(pa.string())}

    ddl = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, ddl)


def restored(output: Column, form: Column) -> Column:
    """The original text, from a transformed one and its form.

    A cut text holds no marker, and none can arise where a part meets a marker, so each
    marker stands once and parts the text.
    """

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        head = F.substring_index(output, second, 1)
        rest = F.substring_index(output, second, -1)
        return F.substring(head, len(first) + 1, 2**31 - 1), F.substring_index(rest, MIDDLE, 1), F.substring_index(rest, MIDDLE, -1)

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    suffix_, prefix_, middle_ = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_, middle_, suffix_)).otherwise(output)
