"""N-gram Jaccard join with rare-first prefix filtering, down to connected components.

1. Every text becomes its set of distinct word shingles (64-bit hashes).  Texts with
   equal sets form a class under one 64-bit key and only one of its rows goes on.
2. All documents vote for how frequent shingles are: a table of ``slots`` counters
   (bounded, one byte each once read) orders shingles from rare to frequent.  The order
   only steers the work; any order gives the same links.
3. Two sets with Jaccard similarity t or more share a shingle among the first
   ``n - ceil(t n) + 1`` of each in that order.  Classes meet at these shingles.
   Where many meet at one shingle, the order was too coarse for their kind: all their
   shingles are counted in a second table, what is frequent there goes to the end of the
   order, and the classes that this touches get new prefixes.  Members of a large family
   then meet at what few of them have, and at the frame of the family only if they have
   little else.
4. Only shingles at which two classes meet go on.  In each of a few rounds every class
   is offered random classes of its size that it meets in another component, keeps the
   most alike by the suffix filter and verifies them; linked classes become components.
   A last round pairs everything that still meets in different components, behind the
   length, positional and suffix filters, once per pair, and verifies it.  So a large
   family of near copies costs pairs in proportion to its number, and no link between
   different components is lost.

The suffix filter compares the sizes of the parts of two sets over 256 ranges of the hash:
the sum of the differences never exceeds the symmetric difference.

Defined results: a null text, and one without words, has an empty set and is linked
with nothing; a text with fewer words than a shingle has one shingle, its whole
sequence; rows that repeat a doc_id are separate documents, linked by their own texts; a
null doc_id names a component only where no other is there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, fits_broadcast, fresh, map_batches, materialize
from .components import components
from .hashing import distinct_shingles, mixed, words_of

#: Counters of the frequency table; bounds what is broadcast (bytes) and collected.
SLOTS = 1 << 22
#: Ranges of the suffix filter.
PARTS = 256
#: Largest size of a part that is told apart, a byte; cutting both sides there only makes the filter weaker.
MOST_IN_PART = 127
#: A shingle is frequent when its counter passes this many times the mean counter (and this many at least).
FREQUENT = 4
LEAST_FREQUENT = 16
#: Postings of one shingle from which on the shingles of its classes are counted again.
CROWD = 64
#: Rounds of offers before the last round, and partners that a class keeps in each.
OFFER_ROUNDS = 2
PARTNERS = 2
#: Up to so many rows (one or two longs each) of classes, components or texts to verify are joined by broadcast; more by a shuffle.
BROADCAST_ROWS = 500_000
#: Verified pairs of one class are spread over so many groups.
VERIFY_GROUPS = 8


def required(nx, ny, percent: int):
    """Least intersection of sets of these sizes that are linked: 100 i >= percent (nx + ny - i)."""
    return -(-percent * (nx + ny) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def _window(percent: int) -> np.uint64:
    """Shingles whose hash is below this bound are counted: twice the share that prefixes need."""
    return np.uint64(min((1 << 64) - 1, int((1 << 64) * min(1.0, 2 * (1 - percent / 100)))))


def _key(own: np.ndarray) -> int:
    """What identifies a set: two independent sums over its shingles and its size, mixed to 64 bits."""
    two = mixed(own + np.uint64(1)).sum(dtype=np.uint64)
    return int(mixed(own.sum(dtype=np.uint64)[None] + mixed(two[None] + np.uint64(len(own)))).view(np.int64)[0])


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("of"))


def describe(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, hash of the text, size of the set and key of the set."""

    def work(batch: pa.RecordBatch, _) -> dict:
        sets = [own for words in words_of(batch.column(1), lower=True) for _, own in distinct_shingles(words, n)]
        return {"doc_id": batch.column(0), "of": batch.column(2), "size": [len(own) for own in sets], "key": [_key(own) for own in sets]}

    return map_batches(_texts(docs), work, "doc_id long, of long, size long, key long")


def frequency_levels(docs: DataFrame, n: int, percent: int, slots: int = SLOTS, every: bool = False) -> np.ndarray:
    """One byte per slot: 0 for rare shingles, else grows with the logarithm of the number of documents; ``every`` counts all shingles."""
    window, mask = _window(percent), np.uint64(slots - 1)

    def work(batch: pa.RecordBatch, _) -> dict:
        found = [(mixed(own if every else own[own < window]) & mask).astype(np.int32) for words in words_of(batch.column(1), lower=True) for _, own in distinct_shingles(words, n)]
        slot, times = np.unique(np.concatenate(found), return_counts=True)
        return {"slot": slot, "n": times.astype(np.int32)}

    counts = map_batches(_texts(docs), work, "slot int, n int").groupBy("slot").agg(F.sum("n").alias("n"))
    counts = materialize(counts)  # at most ``slots`` rows, whatever the size of the corpus
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(LEAST_FREQUENT, FREQUENT * total // slots)
    found = counts.filter(F.col("n") >= least).toArrow()  # at most ``slots / FREQUENT`` rows
    levels = np.zeros(slots, dtype=np.uint8)
    levels[found.column("slot").to_numpy()] = np.clip(1 + 8 * np.log2(found.column("n").to_numpy() / least), 1, 255).astype(np.uint8)
    return levels


def _level(own: np.ndarray, levels: np.ndarray) -> np.ndarray:
    return levels[(mixed(own) & np.uint64(len(levels) - 1)).astype(np.int64)].astype(np.int16)


def ordered(own: np.ndarray, levels: np.ndarray, percent: int, crowded: np.ndarray | None = None) -> np.ndarray:
    """Shingles from rare to frequent: counted and rare, then little frequent, then not counted, then the rest, then those of crowds."""
    level = _level(own, levels)
    key = np.where(own >= _window(percent), 33, level + (level > 32))
    if crowded is not None:
        level = _level(own, crowded)
        key = np.where(level > 0, 512 + level, key)
    return own[np.lexsort((own, key))]


def signatures(docs: DataFrame, n: int, percent: int, levels, crowded=None) -> DataFrame:
    """doc_id, key, size, prefix shingles in order and the sizes over the ranges of the suffix filter."""

    def work(batch: pa.RecordBatch, _) -> dict:
        ids, key, size, prefix, parts = [], [], [], [], []
        names = batch.column(0).to_pylist()
        for words in words_of(batch.column(1), lower=True):
            for t, own in distinct_shingles(words, n):
                if len(own):
                    ids.append(names[t])
                    key.append(_key(own))
                    size.append(len(own))
                    prefix.append(ordered(own, levels.value, percent, crowded and crowded.value)[: prefix_length(len(own), percent)].view(np.int64))
                    parts.append(np.minimum(np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=PARTS), MOST_IN_PART).astype(np.int8))
        return {"doc_id": ids, "key": key, "size": size, "prefix": prefix, "parts": parts}

    return map_batches(_texts(docs), work, "doc_id long, key long, size long, prefix array<bigint>, parts array<tinyint>")


def _by_shingle(postings: DataFrame, work, ddl: str) -> DataFrame:
    """``work`` on batches of whole groups of postings with equal shingles.

    Rows arrive sorted by (shingle, size, key); only a group that is still open is carried
    to the next batch.  ``work(table, bounds)`` gets the arrays of ``_POSTING`` and the
    rows at which groups begin and end; it returns a list of arrays.
    """
    names = [x.split()[0] for x in ddl.split(", ")]

    def run(batches):
        held = None

        def done(table: list, bounds: np.ndarray):
            found = work([c[: bounds[-1]] for c in table], bounds)
            if len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=names)

        for batch in batches:
            if batch.num_rows:
                table = [c.to_numpy() for c in batch.columns]
                table = table if held is None else [np.concatenate(x) for x in zip(held, table)]
                bounds = np.concatenate([[0], np.flatnonzero(np.diff(table[0])) + 1])
                held = [c[bounds[-1] :] for c in table]
                yield from done(table, bounds)
        if held is not None:
            yield from done(held, np.array([0, len(held[0])]))

    return postings.select(*_POSTING).repartition("shingle").sortWithinPartitions("shingle", "size", "key").mapInArrow(run, ddl)


_ROUND = np.uint64(0x9E3779B97F4A7C15)
_POSTING = ["shingle", "key", "size", "at", "component"]


def shared_postings(postings: DataFrame) -> DataFrame:
    """The postings at shingles where two or more classes meet."""

    def work(table: list, bounds: np.ndarray) -> list:
        rows = np.diff(bounds)
        return [c[np.repeat(rows > 1, rows)] for c in table[:4]]

    return _by_shingle(postings, work, "shingle long, key long, size long, at int")


def _mixed_groups(table: list, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First rows of the groups of two rows, and numbers of the larger groups, that hold more than one component."""
    none = np.zeros(0, dtype=np.int64)
    if len(bounds) < 2:
        return none, none
    rows, component = np.diff(bounds), table[4]
    mixed_ = np.minimum.reduceat(component, bounds[:-1]) != np.maximum.reduceat(component, bounds[:-1])
    return bounds[:-1][mixed_ & (rows == 2)], np.flatnonzero(mixed_ & (rows > 2))


def offers(postings: DataFrame, percent: int, round_: int) -> DataFrame:
    """Pairs (a, b): for each class b two random classes of its size band and the one before it in size, of other components."""

    def group(shingle, key, size, at, component):
        k, lead = len(key), 0
        band = np.zeros(k, dtype=np.int64)
        while lead < k:
            last = max(lead + 1, int(np.searchsorted(size, size[lead] * 100 // percent, side="right")))
            band[lead:last] = lead
            lead = last
        # dealt by key and round alone: a family proposes the same pairs at all shingles that it shares
        dealt = np.lexsort((mixed(key.view(np.uint64) + _ROUND * np.uint64(round_ + 1)), band))
        left = np.concatenate([dealt[:-1], dealt[:-2], np.arange(k - 1)])
        right = np.concatenate([dealt[1:], dealt[2:], np.arange(1, k)])
        other = (component[left] != component[right]) & (key[left] != key[right])
        return key[left[other]], key[right[other]]

    def work(table: list, bounds: np.ndarray) -> list:
        two, larger = _mixed_groups(table, bounds)
        key = table[1]
        found = [(key[two], key[two + 1]), *(group(*(c[bounds[g] : bounds[g + 1]] for c in table)) for g in larger)]
        return [np.concatenate(x) for x in zip(*found)]

    return _by_shingle(postings, work, "a long, b long")


def meetings(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a < b, of different components that the length and positional filters leave."""

    def near(size, at, i, j):
        """Whether rows i, j (size of i at most that of j) may be linked."""
        rest = 1 + np.minimum(size[i] - at[i] - 1, size[j] - at[j] - 1)
        return (100 * size[i] >= percent * size[j]) & (rest >= required(size[i], size[j], percent))

    def group(shingle, key, size, at, component):
        left, right = [], []
        for i in range(len(key) - 1):
            j = np.arange(i + 1, int(np.searchsorted(size, size[i] * 100 // percent, side="right")))
            j = j[(component[j] != component[i]) & (key[j] != key[i]) & near(size, at, i, j)]
            left.append(np.full(len(j), key[i]))
            right.append(key[j])
        return np.concatenate(left), np.concatenate(right)

    def work(table: list, bounds: np.ndarray) -> list:
        two, larger = _mixed_groups(table, bounds)
        two = two[near(table[2], table[3], two, two + 1)]
        found = [(table[1][two], table[1][two + 1]), *(group(*(c[bounds[g] : bounds[g + 1]] for c in table)) for g in larger)]
        a, b = (np.concatenate(x) for x in zip(*found))
        return [np.minimum(a, b), np.maximum(a, b)]

    return _by_shingle(postings, work, "a long, b long").distinct()


def suffix_filter(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the sizes over the ranges of the hash do not rule out, with their relative distance."""
    sides = [known.select(F.col("key").alias(x), F.col("size").alias(f"n{x}"), F.col("parts").alias(f"p{x}")) for x in "ab"]
    apart = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.abs(x.cast("int") - y)), F.lit(0), lambda s, x: s + x)
    both = F.col("na") + F.col("nb")
    met = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", both.alias("both"), apart.alias("apart"))
    # i >= percent (na + nb) / (100 + percent) and i = (na + nb - difference) / 2
    return met.filter(F.col("apart") * (100 + percent) <= F.col("both") * (100 - percent)).select("a", "b", (F.col("apart") / F.col("both")).alias("distance"))


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets are similar enough; ``sets`` has key and the sorted shingles as bytes.

    The set of ``a`` comes once per group of its partners and the partners stream past it.
    """
    group = F.pmod(F.xxhash64("b"), F.lit(VERIFY_GROUPS)).cast("int").alias("g")
    partners = pairs.select("a", "b", group).join(sets.select(F.col("key").alias("b"), "shingles"), "b").select("a", "g", "b", "shingles")
    heads = pairs.select("a", group).distinct().join(sets.select(F.col("key").alias("a"), "shingles"), "a").select("a", "g", F.lit(None).cast("long").alias("b"), "shingles")
    dealt = heads.union(partners).repartition("a", "g").sortWithinPartitions("a", "g", F.col("b").asc_nulls_first())
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        head = None
        for batch in batches:
            left, right = [], []
            for a, b, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                own = np.frombuffer(raw.as_buffer(), dtype=np.uint64)
                if b is None:
                    head = own.copy()
                    continue
                small, large = (own, head) if len(own) < len(head) else (head, own)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                shared = int(np.count_nonzero(large[at] == small))
                if 100 * shared >= percent * (len(own) + len(head) - shared):
                    left.append(a)
                    right.append(b)
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], schema=out)

    return dealt.mapInArrow(run, "a long, b long")


def shingle_sets(docs: DataFrame, pairs: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """key and sorted distinct shingles (bytes) of the classes in ``pairs``."""

    def work(batch: pa.RecordBatch, _) -> dict:
        found = [own for words in words_of(batch.column(1), lower=True) for _, own in distinct_shingles(words, n)]
        return {"key": [_key(own) for own in found], "shingles": [own.tobytes() for own in found]}

    keys = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    return map_batches(_texts_of(docs, keys, classes), work, "key long, shingles binary")


def _texts_of(docs: DataFrame, keys: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of ``_texts`` that stand for the classes in ``keys``."""
    # one number stands for a null doc_id; a text that comes along for that reason does no harm
    lowest = F.lit(-(1 << 63)).cast("long")
    rows = materialize(classes.join(keys, "key").select(F.coalesce("rep", lowest).alias("_rep")).distinct())
    rows, texts = _small(rows), _texts(docs)
    return texts.join(rows, F.coalesce(texts["doc_id"], lowest) == rows["_rep"], "left_semi")


def _postings(known: DataFrame) -> DataFrame:
    return known.select(F.posexplode("prefix").alias("at", "shingle"), "key", "size").withColumn("component", F.lit(0).cast("long"))


def _touched(known: DataFrame, crowded) -> DataFrame:
    """Keys of the classes with a shingle of the crowds in their prefix."""

    def work(batch: pa.RecordBatch, _) -> dict:
        hit = [bool(_level(np.asarray(p, dtype=np.int64).view(np.uint64), crowded.value).any()) for p in batch.column(1).to_pylist()]
        return {"key": batch.column(0).filter(pa.array(hit))}

    return map_batches(known.select("key", "prefix"), work, "key long")


def spread_crowds(docs: DataFrame, n: int, percent: int, slots: int, levels, classes: DataFrame, known: DataFrame, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``known`` and ``shared`` (written tables) in an order that knows what is frequent where many classes meet at one shingle.

    Shingles of the crowds move behind all others, so a class without one in its prefix keeps its prefix.
    """
    crowds = materialize(shared.groupBy("shingle").count().filter(F.col("count") >= CROWD).select("shingle"))
    if not crowds.limit(1).count():
        return known, shared
    inside = materialize(shared.join(_small(crowds), "shingle", "left_semi").select("key").distinct())
    crowded = docs.sparkSession.sparkContext.broadcast(frequency_levels(_texts_of(docs, inside, classes), n, percent, slots, every=True))
    touched = _small(materialize(_touched(known, crowded).distinct()))
    again = signatures(_texts_of(docs, touched, classes), n, percent, levels, crowded)
    again = materialize(again.join(touched, "key", "left_semi").dropDuplicates(["key"]).select("key", "size", "prefix", "parts"))
    rest = known.join(touched, "key", "left_anti")
    new = _small(materialize(_postings(again).select("shingle").distinct()))
    met = shared_postings(_postings(again).unionByName(_postings(rest).join(new, "shingle", "left_semi")))
    # postings at other shingles meet as before
    kept = shared.join(touched, "key", "left_anti").join(new, "shingle", "left_anti")
    return rest.unionByName(again), materialize(kept.unionByName(met))


def _small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast where it is within the bound."""
    return F.broadcast(df) if fits_broadcast(df, BROADCAST_ROWS) else df


def grouped(docs: DataFrame, n: int, percent: int, slots: int = SLOTS) -> DataFrame:
    """doc_id, of (hash of the text), size, component (null without words) and component_id for every row of ``docs`` (doc_id, text)."""
    sets = materialize(describe(docs, n))
    classes = materialize(sets.filter("size > 0").groupBy("key").agg(F.min("doc_id").alias("rep")))
    levels = docs.sparkSession.sparkContext.broadcast(frequency_levels(docs, n, percent, slots))
    signed = signatures(docs, n, percent, levels)
    own = _small(classes.select(F.col("key").alias("_key"), "rep"))
    known = materialize(signed.join(own, (signed["key"] == own["_key"]) & signed["doc_id"].eqNullSafe(own["rep"]), "left_semi").drop("doc_id"))
    shared = materialize(shared_postings(_postings(known)))
    whole = known
    coarse = shared
    known, shared = spread_crowds(docs, n, percent, slots, levels, classes, known, shared)
    if shared is not coarse:
        discard(coarse)
    known = materialize(known.select("key", "size", "parts").join(shared.select("key").distinct(), "key", "left_semi"))
    discard(whole)

    def verified(pairs: DataFrame) -> DataFrame:
        texts = materialize(shingle_sets(docs, pairs, classes, n))
        found = materialize(verify(pairs, texts, percent))
        discard(texts)
        return found

    def placed(around: DataFrame | None) -> DataFrame:
        if around is None:
            return shared.withColumn("component", F.col("key"))
        return shared.join(_small(around.withColumnRenamed("node", "key")), "key", "left").withColumn("component", F.coalesce("component", "key"))

    links = around = None
    best = Window.partitionBy("b").orderBy("distance", "a")
    for round_ in range(OFFER_ROUNDS):
        met = suffix_filter(offers(placed(around), percent, round_).distinct(), known, percent)
        chosen = met.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= PARTNERS)
        chosen = materialize(chosen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        found = verified(chosen)
        links = found if links is None else links.union(found)
        around = materialize(components(links))

    rest = verified(materialize(suffix_filter(meetings(placed(around), percent), known, percent).select("a", "b")))
    # only one link between two components matters from here on
    for x in "ab":
        rest = rest.join(around.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")), x, "left").withColumn(x, F.coalesce(f"c{x}", x))
    joins = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    linked = components(links.union(joins)).join(classes, F.col("node") == F.col("key")).select("key", "component", "rep")
    least = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = classes.join(linked.join(least, "component").select("key", "component", "component_id"), "key", "left")
    named = named.select("key", F.coalesce("component", "key").alias("component"), F.coalesce("component_id", "rep").alias("component_id"))
    # an empty set is no class, so its document is a component of its own
    return sets.join(named, "key", "left").select("doc_id", "of", "size", "component", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, n: int, percent: int, slots: int = SLOTS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text)."""
    return grouped(docs, n, percent, slots).select("doc_id", F.col("size").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, n: int, percent: int, slots: int = SLOTS) -> DataFrame:
    """Rows of ``docs`` with all columns: of each component the one with the smallest doc_id, and all rows without words."""
    rows = materialize(grouped(docs, n, percent, slots))
    keeper = rows.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min(F.struct("doc_id", "of")).alias("k")).select("k.*")
    kept = keeper.union(rows.filter(F.col("component").isNull()).select("doc_id", "of")).distinct()
    kept = kept.select(F.col("doc_id").alias("_id"), F.col("of").alias("_of"))
    found = docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["_id"]) & F.xxhash64(docs["text"].cast("string")).eqNullSafe(kept["_of"]), "left_semi")
    repeats = rows.filter(F.col("component").isNotNull()).groupBy("doc_id", "of").count().filter("count > 1")
    if not repeats.limit(1).count():
        return found
    # rows that repeat id and text are one document; the other columns come from the first of them
    place = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(*[F.col(c).cast("string") for c in docs.columns])
    number = fresh(docs.columns, "_n")
    numbered = found.withColumn(number, F.row_number().over(place))
    return numbered.filter((F.col(number) == 1) | ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))).drop(number)
