"""Language identification by compression.

Each language gets a raw-content dictionary made of sample lines.  A text is cut
into pieces and compressed once with every dictionary; the language whose
dictionary gives the fewest bytes wins.  A text is rejected when it has no letter,
or when its two best totals are nearly equal, by one rule for all lengths.

Defined results: a null text and a text without letters give ``und`` with score 0;
equal totals go to the language with more sampled rows, then to the smaller name;
one learned language gives score 1 to everything; no learned language gives ``und``
for all rows.  Extra columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import carry

#: Rows of each language whose text may enter its dictionary, and bytes of the dictionary.
SAMPLE_ROWS = 400
DICTIONARY_BYTES = 100_000
#: Bytes of a sampled text that may enter, so that long texts do not fill a dictionary alone.
SHARE_BYTES = 1_500
PIECE_BYTES = 4_000
LEVEL = 6
#: A text is rejected, whatever its length, if its two best sizes differ by less than this share; for short texts, whose sizes are small whole numbers, that is a tie.
NARROW = 0.002


def held_out(doc_id: Column) -> Column:
    """Rows kept out of training: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, tuple[int, bytes]]:
    """Dictionaries from ``labelled`` (doc_id, text, lang); at most ``sample_rows`` rows per language.

    The sample takes the smallest hashes of the id among texts with letters, a documented
    bound.  What reaches the driver is one dictionary per language.
    """
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    top = Window.partitionBy("lang").orderBy(*order)
    ids = usable.select("doc_id", "lang").withColumn("_n", F.row_number().over(top)).filter(F.col("_n") <= sample_rows)
    ids = ids.select("doc_id", "lang", "_n").withColumnRenamed("lang", "_lang")
    sample = usable.select("doc_id", "text", "lang").join(
        F.broadcast(ids), usable["doc_id"].eqNullSafe(ids["doc_id"]) & (usable["lang"] == ids["_lang"])
    ).select("lang", "_n", "text")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        seen: set[str] = set()
        parts: list[bytes] = []
        size = 0
        for text in pdf.sort_values(["_n", "text"]).text.drop_duplicates():
            own = 0
            for line in text.lower().split("\n"):
                if line in seen or own > SHARE_BYTES:
                    continue
                seen.add(line)
                raw = f" {line} ".encode()[:SHARE_BYTES]
                parts.append(raw)
                own += len(raw)
            size += own
            if size >= dictionary_bytes:
                break
        # the end of a dictionary is nearest to the text, so the first sampled rows stand there
        return pd.DataFrame({"lang": [pdf.lang.iloc[0]], "n": [len(pdf)], "content": [b"".join(reversed(parts))[-dictionary_bytes:]]})

    found = sample.groupBy("lang").applyInPandas(build, "lang string, n long, content binary").collect()
    return {r["lang"]: (r["n"], bytes(r["content"])) for r in found}


def _compressors(dictionaries: dict[str, tuple[int, bytes]]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang in sorted(dictionaries, key=lambda k: (-dictionaries[k][0], k)):
        d = zstandard.ZstdCompressionDict(dictionaries[lang][1], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return out


def _pieces(raw: bytes) -> Iterator[bytes]:
    for at in range(0, len(raw), PIECE_BYTES):
        yield raw[at : at + PIECE_BYTES]


def classify_text(text: str | None, compressors: list) -> tuple[str, float, bool]:
    """(language, score, rejected) of one text; the score is the relative margin of the best two."""
    found = 0 if text is None else len(re.findall(r"[^\W\d_]", text))
    if not found or not compressors:
        return "und", 0.0, True
    raw = f" {text.lower()} ".encode(errors="replace")
    sizes = [sum(len(c.compress(p)) for p in _pieces(raw)) for _, c in compressors]
    best = min(range(len(sizes)), key=lambda i: sizes[i])
    rest = [s for i, s in enumerate(sizes) if i != best]
    score = 1.0 if not rest else 1.0 - sizes[best] / min(rest)
    return compressors[best][0], score, score < NARROW


def _predict(docs: DataFrame, dictionaries: dict[str, tuple[int, bytes]]) -> tuple[DataFrame, dict[str, Column]]:
    """lang_pred, score, rejected beside the carried columns of ``docs``; the only input of a prediction is ``text``.

    The dictionaries are broadcast: their number is that of the languages, their size is bounded.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def work(batch: pa.RecordBatch, compressors: list) -> dict:
        found = [classify_text(t, compressors) for t in batch.column(0).to_pylist()]
        return dict(zip(("lang_pred", "score", "rejected"), zip(*found)))

    return carry(docs, ["text"], work, "lang_pred string, score double, rejected boolean", lambda: _compressors(shared.value))


def _training(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string")).filter(~held_out(F.col("doc_id")))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for every row of ``docs`` (doc_id, text, lang)."""
    found, own = _predict(docs.select("doc_id", "text"), fit(_training(docs)))
    return found.select(own["doc_id"], "lang_pred", "score", "rejected").withColumn("held_out", held_out(F.col("doc_id")))


def keep_identified(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are not rejected, with all their columns."""
    found, own = _predict(docs, fit(_training(docs)))
    return found.filter(~F.col("rejected")).select(*own.values())
