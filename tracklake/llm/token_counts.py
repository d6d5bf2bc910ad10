"""Token counts of documents under a unigram vocabulary, by dynamic programming on a trie.

A text is cut at white space into pre-tokens (each with the word mark in front).  The
best segmentation of a pre-token is the one with the largest sum of piece scores, and
of those with equal sums the one with fewer pieces.  Its forward scores depend on the
prefix alone, so each task inserts the distinct pre-tokens it meets into a trie,
computes the forward score and count of a node when the node is made, and stores the
count at the terminal.  A known pre-token costs one lookup.

The vocabulary is a public file whose pieces are ordered by rank; nothing is trained.
Scores are the log probabilities of a Zipf distribution over the ranks.  A character
without a piece takes one byte piece per byte of its UTF-8 form.

Defined results: a null text and a text of white space have no pre-tokens and no
tokens; repeated rows are counted each.  The trie of a task is emptied when it passes
``TRIE_NODES`` nodes; that changes no result.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

TRIE_NODES = 800_000
# fixed value: the mark that stands for the space before a word in this vocabulary
WORD_MARK = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(model_path: str | None = None) -> tuple[dict[str, float], float]:
    """Piece scores and the score of one byte piece (that of the last rank)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path or default_model())
    ordered = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1 / r for r in range(1, len(ordered) + 1)))
    return {p: -math.log(r) - total for r, p in enumerate(ordered, 1)}, -math.log(len(ordered)) - total


class Trie:
    """Distinct pre-tokens with forward scores; ``trie[word]`` is the count stored at the terminal of ``word``."""

    def __init__(self, pieces: dict[str, float], byte_score: float, most_nodes: int = TRIE_NODES):
        self.pieces, self.byte_score, self.most_nodes = pieces, byte_score, most_nodes
        # ends of pieces: a longer run that is none of them cannot be a piece
        self.ends = {p[i:] for p in pieces for i in range(len(p))}
        self.clear()

    def clear(self) -> None:
        self.next: dict[int, int] = {}  # (parent, character) as one number
        self.score, self.count = [0.0], [0]
        self.terminal: dict[bytes, int] = {}

    def __getitem__(self, word: bytes) -> int:
        found = self.terminal.get(word)
        return self.insert(word) if found is None else found

    def insert(self, word: bytes) -> int:
        if len(self.score) > self.most_nodes or len(self.terminal) > self.most_nodes:
            self.clear()
        text = WORD_MARK + word.decode("utf-8", errors="replace")
        path, node = [0], 0
        for end, char in enumerate(text, 1):
            step = node << 21 | ord(char)
            child = self.next.get(step)
            if child is None:
                child = len(self.score)
                self.next[step] = child
                self._forward(text, end, path, char)
            node = child
            path.append(node)
        self.terminal[word] = self.count[node]
        return self.count[node]

    def _forward(self, text: str, end: int, path: list[int], char: str) -> None:
        """Score and count of the new node for ``text[:end]`` from those of its ancestors."""
        size = len(char.encode("utf-8"))
        best = self.score[path[end - 1]] + size * self.byte_score
        number = self.count[path[end - 1]] + size
        for start in range(end - 1, -1, -1):
            run = text[start:end]
            if run not in self.ends:
                break
            own = self.pieces.get(run)
            if own is not None:
                score, pieces = self.score[path[start]] + own, self.count[path[start]] + 1
                if score > best or score == best and pieces < number:
                    best, number = score, pieces
        self.score.append(best)
        self.count.append(number)


def count_tokens(docs: DataFrame, model_path: str | None = None, most_nodes: int = TRIE_NODES) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of every row of ``docs`` (doc_id, text)."""

    def work(batch: pa.RecordBatch, trie: Trie) -> dict:
        words = [(t or "").encode("utf-8", errors="replace").split() for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "n_pretokens": [len(w) for w in words], "n_tokens": [sum(map(trie.__getitem__, w)) for w in words]}

    return map_batches(
        docs.select(F.col("doc_id").cast("long"), "text"), work, "doc_id long, n_pretokens long, n_tokens long", lambda: Trie(*load_pieces(model_path), most_nodes)
    )
