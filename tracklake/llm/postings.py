"""Benchmark decontamination on a positional inverted index, in column functions only.

Index: one posting (term, document, position) per word of a document that any benchmark
item has, written as a table in the order of the documents, so storing it takes no
shuffle.  A document is known by its id and the hash of its text.

Search: the windows of all items (``size`` consecutive words; a shorter item is one
window) are made distinct and their terms are ordered from rare to frequent by the
number of postings.  The list of a window's rarest term, each position less the term's
offset, gives the places where the window may start; the list of the second term, adjusted
alike, is intersected with it, and what is left is intersected with the lists of all other
terms at once.  Only postings of terms that take part in a step are read for it, and from
the third step on only those of documents that are still in question.  A window with a
term that has no posting starts nowhere.

With ``slop`` a term may stand up to so many words from its place relative to the rarest
term (proximity match); 0 is the exact phrase.

Lists of frequent terms are long but never gathered: all steps are equi-joins on
(document, position, term), which no hot term can fill.  The lists of the first step are
joined by term with the table of windows, which is broadcast up to ``BROADCAST_TERMS`` rows
and dealt over ``SALT`` copies beyond.

Defined results: null texts and items, and those without a word, have no words; an item
with a null id hits words but is not counted as an item; items that repeat an id count
once; rows that repeat doc_id and text get equal results; without items nothing is hit;
an empty table gives no row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

# fixed value: the word rule, on lower-cased A-Z
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Copies of the windows of one term where they are joined by a shuffle.
SALT = 32
#: Up to so many distinct words of the benchmark (and windows of it) go along by broadcast.
BROADCAST_TERMS = 200_000
#: Up to so many documents that are still in question before the last step (one long each) select its postings by broadcast.
BROADCAST_DOCS = 1_000_000


def words(text: Column) -> Column:
    """Words of a text as they stand; ``lowered`` gives the form that is compared."""
    return F.regexp_extract_all(text.cast("string"), F.lit(WORD), F.lit(0))


def lowered(word: Column) -> Column:
    """A-Z in lower case and nothing else: ``lower`` is exact for a word of single bytes."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def vocabulary(benchmark: DataFrame) -> DataFrame:
    """word, term: the distinct words of the benchmark and a number for each."""
    found = benchmark.select(F.explode(words(F.col("text"))).alias("word")).select(lowered(F.col("word")).alias("word"))
    return found.distinct().withColumn("term", F.xxhash64("word"))


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id and ``terms`` (array) of all windows of all items."""
    text = F.transform(words(F.col("text")), lambda w: F.xxhash64(lowered(w)))
    own = benchmark.select("item_id", text.alias("own")).filter(F.size("own") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("own") - size + 1, F.lit(1)))
    return own.select("item_id", "own", F.explode(starts).alias("at")).select("item_id", F.slice("own", F.col("at"), size).alias("terms"))


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= rows else df


def _named(docs: DataFrame) -> list[Column]:
    """What a document is known by: its id (the lowest number stands for null) and the hash of its text."""
    return [F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63)).cast("long")).alias("doc_id"), F.xxhash64(docs["text"].cast("string")).alias("of")]


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, doc_id, of (hash of the text), pos: the postings of ``docs`` (doc_id, text) for the words in ``terms``, written."""
    found = docs.select(*_named(docs), F.posexplode(words(F.col("text"))).alias("pos", "word"))
    named = found.withColumn("word", lowered(F.col("word")))
    return materialize(named.join(_bounded(terms, BROADCAST_TERMS), "word").select("term", "doc_id", "of", "pos"))


@dataclass(slots=True)
class Plan:
    """Distinct windows with their terms from rare to frequent."""

    members: DataFrame  # window, item_id
    ranked: DataFrame  # window, k, rank, term, offset


def rarest_first(own: DataFrame, frequency: DataFrame) -> Plan:
    """``own`` (item_id, terms) as a plan; windows with a term without postings are left out."""
    key = F.struct(F.xxhash64("terms").alias("x"), F.xxhash64(F.lit(1), "terms").alias("y"))
    named = own.select("item_id", "terms", key.alias("window"))
    members = materialize(named.select("window", "item_id").distinct())
    each = named.dropDuplicates(["window"]).select("window", F.size("terms").alias("k"), F.posexplode("terms").alias("offset", "term"))
    known = each.join(_bounded(frequency, BROADCAST_TERMS), "term", "left")
    # a window has at most ``size`` rows, so its lists are small arrays
    lists = known.groupBy("window", "k").agg(F.array_sort(F.collect_list(F.struct("n", "term", "offset"))).alias("lists"), F.count("n").alias("held"))
    ranked = lists.filter(F.col("held") == F.col("k")).select("window", "k", F.posexplode("lists").alias("rank", "l"))
    return Plan(members, materialize(ranked.select("window", "k", "rank", "l.term", "l.offset")))


PLACE = ["doc_id", "of", "pos", "term"]


def _at(starts: DataFrame, lists: DataFrame, slop: int) -> DataFrame:
    """The postings that would confirm ``starts``: one row per list and place it may stand at."""
    near = F.explode(F.sequence(F.lit(-slop), F.lit(slop))).alias("by")
    wanted = starts.join(lists, "window").select("*", near) if slop else starts.join(lists, "window").withColumn("by", F.lit(0))
    return wanted.withColumn("pos", F.col("start") + F.col("offset") + F.col("by"))


def matches(postings: DataFrame, plan: Plan, slop: int = 0) -> DataFrame:
    """doc_id, of, window, k, start: where windows stand in documents, each once.

    ``start`` is the place of the window's first word reckoned from its rarest term.
    """
    ranked = plan.ranked
    first = ranked.filter("rank = 0").select("window", "k", "term", "offset")
    few = first.count() <= BROADCAST_TERMS
    if few:
        started = postings.join(F.broadcast(first), "term")
    else:
        salted = postings.withColumn("salt", F.pmod(F.xxhash64("doc_id", "of", "pos"), F.lit(SALT)))
        copies = first.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
        started = salted.join(copies, ["term", "salt"])
    # rows that repeat id and text have the same postings, so their starts are made one below
    start = (F.col("pos") - F.col("offset")).alias("start")
    starts = materialize(started.select("doc_id", "of", "window", "k", start).filter(F.col("start") >= -slop))
    alone = starts.filter("k = 1").distinct()

    second = ranked.filter("rank = 1").select("window", "term", "offset")
    terms = second.select("term").distinct()
    seconds = postings.join(_bounded(terms, BROADCAST_TERMS), "term", "left_semi")
    left = _at(starts.filter("k > 1"), F.broadcast(second) if few else second, slop).join(seconds, PLACE, "left_semi").select("doc_id", "of", "window", "k", "start")
    left = materialize(left.distinct())

    rest = ranked.filter("rank > 1").select("window", "rank", "term", "offset")
    # the last step reads the postings of documents still in question; their hash is enough to select them
    document = F.xxhash64("doc_id", "of")
    asked = left.filter("k > 2").select(document.alias("document")).distinct()
    asked = postings.join(_bounded(asked, BROADCAST_DOCS), document == F.col("document"), "left_semi")
    confirmed = _at(left.filter("k > 2"), F.broadcast(rest) if few else rest, slop).join(asked, PLACE, "left_semi")
    held = confirmed.groupBy("doc_id", "of", "window", "k", "start").agg(F.countDistinct("rank").alias("held")).filter(F.col("held") == F.col("k") - 2)
    return alone.unionByName(left.filter("k = 2")).unionByName(held.drop("held"))


def search(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int = 0) -> tuple[DataFrame, DataFrame]:
    """(matches, window and item_id) of the items of ``benchmark`` (item_id, text) in ``docs`` (doc_id, text)."""
    terms = materialize(vocabulary(benchmark))
    postings = index(docs, terms)
    frequency = materialize(postings.groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    plan = rarest_first(windows(benchmark, size), frequency)
    return materialize(matches(postings, plan, slop)), plan.members


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids of the items that occur) for every row of ``docs``."""
    found, members = search(docs, benchmark, size)
    hit = found.select("doc_id", "of", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("k") - 1)).alias("pos")).distinct()
    n_hit = hit.groupBy("doc_id", "of").agg(F.count(F.lit(1)).alias("n_hit"))
    # the ids of one document are part of its result row
    held = found.select("doc_id", "of", "window").distinct().join(members.filter("item_id IS NOT NULL"), "window").select("doc_id", "of", F.col("item_id").cast("string").alias("item")).distinct()
    items = held.groupBy("doc_id", "of").agg(F.array_sort(F.collect_list("item")).alias("items"))
    result = materialize(n_hit.join(items, ["doc_id", "of"], "full")).withColumnsRenamed({"doc_id": "_id", "of": "_of"})
    name, of = _named(docs)
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), name.alias("_name"), of, F.coalesce(F.size(words(docs["text"])), F.lit(0)).cast("long").alias("n_words"))
    joined = own.join(result, (F.col("_name") == F.col("_id")) & (F.col("of") == F.col("_of")), "left")
    none = F.array().cast("array<string>")
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))
