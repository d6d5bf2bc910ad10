"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating; together they get
``share`` of all words, but none more than ``most_epochs`` times its own words, the
excess going to the others by weight until none is above.

Blocks: the documents of a source stand in a fixed random order and their words are
cut into blocks of ``block_words`` (more where the corpus has above 10^11 words); an affine permutation per source and epoch orders
the blocks, and the mix takes the first ones, the last block in part, so every source
gets its target to the word.

Shards: a tree halves the shards again and again; at each node the number of blocks of
every source that goes left is one multivariate-hypergeometric draw, which leaves every
shard with an exact number of blocks and every source with its exact quota.  The tree is
drawn first over ``GROUPS`` groups of sources (a bounded table on the driver), then
inside each group of sources as one Spark group of one row per source.  A shard takes the
next run of permuted blocks of each source, so shards are disjoint, and shuffles them by a
hash.

Nothing depends on how rows lie in partitions: a rerun gives the same mix.  Sizes and
starts of a source that holds most rows are summed over hash buckets, never in one task.

Defined results: a null text has size 0; a document of size 0, and one of a source
without words, is taken 0 times; repeated rows are separate documents; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, fits_broadcast, materialize

# fixed values of the mix: weights in the order of the sources
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
BLOCK_WORDS = 1024
SHARDS = 16
SEED = 17
#: Groups of sources in the upper part of the tree, and hash buckets of the documents of a source.
GROUPS = 64
BUCKETS = 256
#: Sources that may be joined by broadcast (one short row each); more are joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: Starts of hash buckets that may be joined by broadcast.
BROADCAST_BUCKETS = 500_000
#: Blocks of all sources and epochs at most: blocks double in size until there are no more, and draws stay within the sampler's range.
MOST_BLOCKS = 400_000_000


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and number of words of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"))


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_totals(sized: DataFrame) -> DataFrame:
    """One row per source: its words and its weight."""
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # rank by code point in two steps, so that no task sorts all sources: bytes of UTF-8 sort like code points
    head = F.substring(F.col("source").cast("binary"), 1, 2)
    keyed = total.withColumn("_head", F.when(F.col("source").isNull(), F.lit("~")).otherwise(F.hex(head)))
    heads = keyed.groupBy("_head").agg(F.count(F.lit(1)).alias("_n"))  # at most 65,793 rows
    before = Window.orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)
    first = heads.select("_head", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    place = F.row_number().over(Window.partitionBy("_head").orderBy(F.col("source").cast("binary"))) - 1
    ranked = keyed.withColumn("_at", place).join(first, "_head")
    turn = F.pmod(F.col("_first") + F.col("_at"), F.lit(len(WEIGHTS)))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (turn + 1).cast("int"))
    return ranked.select("source", "source_size", weight.cast("double").alias("weight"))


def with_targets(sources: DataFrame, share: float = SHARE, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """Adds ``target``; each round is one sum over the sources, until no source is above its limit."""
    limit = F.col("source_size") * F.lit(float(most_epochs))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while total:
        stopped = limit <= F.col("weight") * level
        row = sources.agg(
            F.count_if(stopped).alias("n"), F.sum(F.when(stopped, limit).otherwise(0.0)).alias("given"), F.sum(F.when(stopped, 0.0).otherwise(F.col("weight"))).alias("weight")
        ).first()
        if row["n"] == capped or not row["weight"]:
            break
        capped, level = row["n"], (share * total - row["given"]) / row["weight"]
    return sources.withColumn("target", F.least(limit, F.col("weight") * level))


def _permutation(blocks: int, seed: tuple[int, int]) -> tuple[int, int]:
    """Step and shift of the affine permutation ``(block * step + shift) % blocks``."""
    if blocks < 2:
        return 1, 0
    rng = np.random.default_rng(seed)
    step = int(rng.integers(1, blocks))
    while np.gcd(step, blocks) != 1:
        step = step % (blocks - 1) + 1
    return step, int(rng.integers(0, blocks))


def _split_left(rng: np.random.Generator, quotas: np.ndarray, draws: int) -> np.ndarray:
    """How many of each quota go left when ``draws`` of all are drawn without replacement."""
    left, rest = np.zeros_like(quotas), int(quotas.sum())
    for i, q in enumerate(quotas.tolist()):
        rest -= q
        # the sampler takes less than 10^9, which ``block_size`` keeps above the number of all blocks
        left[i] = rng.hypergeometric(q, rest, draws) if draws and q else 0
        draws -= int(left[i])
    return left


def split_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Quotas per shard (rows: shards) of exact quotas per group; shard totals differ by at most one."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def go(first: int, last: int, own: np.ndarray) -> None:
        if last - first == 1:
            out[first] = own
            return
        middle = (first + last) // 2
        total = int(own.sum())
        # shard i gets the blocks from total * i // n to total * (i + 1) // n of its node
        left = _split_left(np.random.default_rng((seed, first, last)), own, total * (middle - first) // (last - first))
        go(first, middle, left)
        go(middle, last, own - left)

    go(0, shards, quotas)
    return out


def block_size(words: int, sources: int, block_words: int = BLOCK_WORDS) -> int:
    """``block_words``, doubled until all sources and epochs together have at most ``MOST_BLOCKS`` blocks (two of each source are for its ends)."""
    room = max(1, MOST_BLOCKS - 2 * MOST_EPOCHS * sources)
    while MOST_EPOCHS * words > room * block_words:
        block_words *= 2
    return block_words


def quotas(sources: DataFrame, shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """Adds to each source: words per epoch, blocks, permutation steps, drawn blocks, and where each shard's run of draws ends."""
    blocks = F.ceil(F.col("source_size") / block_words)
    words = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0)
    rest = words - epochs * F.col("source_size")
    base = sources.withColumns({"blocks": blocks.cast("long"), "epochs": epochs.cast("long"), "rest": rest.cast("long")})
    # an upper bound of the draws; the last drawn block is cut at the word that reaches the target
    base = base.withColumn("draws", (F.col("epochs") * F.col("blocks") + F.when(F.col("rest") > 0, F.least("blocks", F.ceil(F.col("rest") / block_words) + 1)).otherwise(0)).cast("long"))
    group = F.pmod(F.xxhash64("source"), F.lit(GROUPS)).cast("int")
    base = base.withColumns({"_group": group, "_seed": F.shiftrightunsigned(F.xxhash64(F.lit(seed), "source"), 1)})
    totals = {r["_group"]: r["n"] for r in base.groupBy("_group").agg(F.sum("draws").alias("n")).collect()}  # at most GROUPS rows
    upper = split_tree(np.array([totals.get(g, 0) for g in range(GROUPS)], dtype=np.int64), shards, seed)
    kept = [c for c in base.columns if c != "_seed"]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name != "_seed")

    def inside(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        g = int(key[0])
        pdf = pdf.sort_values("source", na_position="last", ignore_index=True)
        own = pdf.draws.to_numpy(np.int64)
        ends = np.zeros((shards, len(own)), dtype=np.int64)

        def go(first: int, last: int, mine: np.ndarray) -> None:
            if last - first == 1:
                ends[first] = mine
                return
            middle = (first + last) // 2
            left = _split_left(np.random.default_rng((seed, g + 1, first, last)), mine, int(upper[first:middle, g].sum()))
            go(first, middle, left)
            go(middle, last, mine - left)

        go(0, shards, own)
        pdf["ends"] = list(np.cumsum(ends, axis=0).T)
        pdf["step"], pdf["shift"] = zip(*(_permutation(int(b), (seed, int(h))) for b, h in zip(pdf.blocks, pdf._seed)))
        return pdf[[*kept, "ends", "step", "shift"]]

    return base.groupBy("_group").applyInPandas(inside, f"{ddl}, ends array<bigint>, step long, shift long").drop("_group")


def placed(sized: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds ``start``: the word at which each document begins in the fixed random order of its source."""
    order = F.xxhash64(F.lit(seed), "doc_id", "size")
    dealt = sized.withColumns({"_order": order, "_bucket": F.pmod(F.shiftright(order, 20), F.lit(BUCKETS)).cast("int")})
    buckets = dealt.groupBy("source", "_bucket").agg(F.sum("size").alias("_words"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = buckets.select(F.col("source").alias("_source"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("source", "_bucket").orderBy("_order", "doc_id", *[c for c in sized.columns if c not in ("doc_id", "source")])
    own = dealt.withColumn("_at", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    # a small table of bucket starts, so that the rows (with their texts) are shuffled once, for the order inside buckets
    first = materialize(first)
    if fits_broadcast(first, BROADCAST_BUCKETS):
        first = F.broadcast(first)
    joined = own.join(first, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn("start", F.col("_first") + F.col("_at")).drop("_order", "_bucket", "_source", "_b", "_first", "_at")


def draws(block_words: int = BLOCK_WORDS) -> Column:
    """For a document (start, size) the parts of it that the mix takes: epoch, shard, first word in the document, words.

    One part per touched block and epoch; the number of blocks grows with the document only.
    """
    def part(block: Column, epoch: int) -> Column:
        first = block * block_words
        low = F.greatest(F.col("start"), first)
        high = F.least(F.col("start") + F.col("size"), first + block_words)
        place = F.pmod(block * F.col("step") + F.col("shift") + epoch * F.col("shift"), F.col("blocks"))
        draw = epoch * F.col("blocks") + place
        # words of this epoch that stand before the block in permuted order: only the last block of a source may be short
        short = F.col("blocks") * block_words - F.col("source_size")
        last_place = F.pmod((F.col("blocks") - 1) * F.col("step") + F.col("shift") + epoch * F.col("shift"), F.col("blocks"))
        before = place * block_words - F.when(last_place < place, short).otherwise(0)
        left = F.when(F.lit(epoch) < F.col("epochs"), high - low).when(F.lit(epoch) == F.col("epochs"), F.least(high, first + F.col("rest") - before) - low).otherwise(0)
        shard = F.size(F.filter(F.col("ends"), lambda e: e <= draw))
        return F.struct(F.lit(epoch).alias("epoch"), shard.cast("int").alias("shard"), (low - F.col("start")).alias("first"), F.greatest(left, F.lit(0)).cast("long").alias("words"))

    touched = F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))

    def epoch_parts(epoch: int) -> Column:
        return F.transform(touched, lambda block: part(block, epoch))

    found = F.filter(F.concat(*map(epoch_parts, range(MOST_EPOCHS))), lambda p: p["words"] > 0)
    return F.when(F.col("size") > 0, found).otherwise(F.array().cast("array<struct<epoch:int,shard:int,first:bigint,words:bigint>>"))


def mix(sized: DataFrame, shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """``sized`` (doc_id, source, size and other columns) with source_size, target and ``parts``."""
    sources = materialize(source_totals(sized))
    size = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.count(F.lit(1)).alias("n")).first()
    block_words = block_size(size["words"], size["n"], block_words)
    planned = materialize(quotas(with_targets(sources), shards, block_words, seed))
    side = planned.withColumnRenamed("source", "_source").drop("weight")
    if fits_broadcast(side, BROADCAST_SOURCES):
        side = F.broadcast(side)
    joined = placed(sized, seed).join(side, F.col("source").eqNullSafe(F.col("_source")))
    return joined.withColumn("parts", draws(block_words)).drop("_source", "blocks", "epochs", "rest", "draws", "ends", "step", "shift")


def taken(mixed: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and the shards (ascending, joined by commas) that hold parts of the document."""
    words = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["words"])
    shards = F.array_join(F.array_sort(F.array_distinct("parts.shard")).cast("array<string>"), ",").alias("shards")
    return mixed.select("doc_id", "size", "source_size", "target", words.alias("taken"), shards)


def shard_parts(mixed: DataFrame, seed: int = SEED) -> DataFrame:
    """The shards: shard, position, doc_id, epoch, first, words; position is the place in the local shuffle."""
    parts = mixed.select("doc_id", F.explode("parts").alias("p")).select("doc_id", "p.*")
    order = F.xxhash64(F.lit(seed), "shard", "doc_id", "epoch", "first")
    return parts.withColumn("position", order).select("shard", "position", "doc_id", "epoch", "first", "words")


def mixed_documents(docs: DataFrame, shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The mix as documents: one row of ``docs`` (all columns) per epoch in which the mix takes words of it.

    A document that is taken in part keeps the taken words with the white space between
    them; ``n_chars`` is counted anew where ``docs`` has it.
    """
    own = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    sized = docs.select(*[docs[c].alias(x) for c, x in own.items()], docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), size_of(docs["text"]).alias("size"))
    rows = mix(sized, shards, block_words, seed)
    epochs = F.explode(F.filter(F.sequence(F.lit(0), F.lit(MOST_EPOCHS - 1)), lambda e: F.exists("parts", lambda p: p["epoch"] == e))).alias("_epoch")
    rows = rows.select(*own.values(), "size", "parts", epochs)
    mine = F.array_sort(F.transform(F.filter("parts", lambda p: p["epoch"] == F.col("_epoch")), lambda p: F.struct(p["first"].alias("first"), p["words"].alias("words"))))
    rows = rows.withColumn("_mine", mine)
    words = F.regexp_extract_all(F.col(own["text"]), F.lit(rf"{WORD}[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform("_mine", lambda p: F.slice(w, (p["first"] + 1).cast("int"), p["words"].cast("int")))), ""))[0]
    whole = F.aggregate("_mine", F.lit(0).cast("long"), lambda n, p: n + p["words"]) == F.col("size")
    text = F.when(whole, F.col(own["text"])).otherwise(F.rtrim(cut))
    new = {"text": text}
    if "n_chars" in own:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, F.col(x)).alias(c) for c, x in own.items()])
