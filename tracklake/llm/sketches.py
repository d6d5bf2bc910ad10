"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs (lines, long ones after sentence ends) and becomes the set
of their 64-bit digests.  With ``bounded``, as the query has it, a paragraph that is still
long is cut again: after sentence marks that symbols follow, after words (characters, where
a script has no spaces) chosen by their hash, and at last after ``MOST_CHARS`` characters.  Every digest is added to one cell in each of three tables: a
cell holds a count, the exclusive or of the digests and that of their check hashes.
Sketches subtract cell by cell; cells with one digest left are peeled until nothing is
left, which recovers exactly the digests of one side and of the other.  If peeling gets
stuck the pair is tried again with tables four times as large.  The sets are first dealt
into blocks by digest, so the work of a long text grows with its length.

The likeness of two sketches is the share of common digests among all of both, which
follows from the two set sizes and the number of recovered digests.

Everything runs on column functions.  The next document of each one is found without a
sort of the whole table in one task: documents are dealt into buckets of the id, and the
first document of a bucket also goes to the bucket before it.

Defined results: a null text counts as empty; equal texts have equal fingerprints; two
empty texts have likeness 1; rows that repeat an id are ordered by their text; a null id
comes first; with one document the next one is itself; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Cells of one of the three tables of the published fingerprint, a power of two.
BASE = 8
#: Sizes that are tried for a pair, each four times the one before.
TRIES = (8, 32, 128, 512, 2048)
ROUNDS = 16
#: Digests of both sides that a block of the larger sketches holds on average.
BLOCK_DIGESTS = 64
#: Characters after which a line may be cut at a sentence end.
LONG_LINE = 80
#: Characters of a paragraph at most, and one word in so many that ends one in a longer paragraph.
MOST_CHARS = 240
CUT_EVERY = 16
#: Words with the white space after them; every character from the East Asian blocks on, and those of scripts without spaces, alone.
TOKEN = r"[^\s\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{2E80}-\x{10FFFF}]+\s*|."
BUCKET_ROWS = 8192
MOST_BUCKETS = 250_000


def _zero() -> Column:
    return F.lit(0).cast("long")


def _cut_again(piece: Column) -> Column:
    """Parts of a long paragraph, cut in places that its words choose wherever they stand."""
    words = F.regexp_extract_all(piece, F.lit(TOKEN), F.lit(0))
    ends = lambda w: (F.pmod(F.xxhash64(F.rtrim(w)), F.lit(CUT_EVERY)) == 0) | w.rlike(r"[.!?\u3002\uFF01\uFF1F][^\p{L}\p{N}]*$")
    marked = F.array_join(F.transform(words, lambda w: F.when(ends(w), F.concat(w, F.lit("\n"))).otherwise(w)), "")
    return F.regexp_extract_all(marked, F.lit(rf"[^\n]{{1,{MOST_CHARS}}}"), F.lit(0))


def digests(text: Column, bounded: bool = False) -> Column:
    """Sorted distinct digests of the paragraphs of a text."""
    pieces = F.regexp_extract_all(text, F.lit(rf"[^\n]{{{LONG_LINE},}}?[.!?](?= )|[^\n]+"), F.lit(0))
    if bounded:
        pieces = F.flatten(F.transform(pieces, lambda p: F.when(F.length(p) > MOST_CHARS, _cut_again(p)).otherwise(F.array(p))))
    return F.array_sort(F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p))))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(7))


def _dealt(items: Column, table: int, size: int, key) -> Column:
    """``items`` by the cell of ``key(item)`` in one table: array of ``size`` arrays; each table uses its own 20 bits.

    They are dealt by at most three bits at a time, so an item is looked at a few times at every size.
    """
    groups, left = F.array(items), size.bit_length() - 1
    while left:
        bits = min(3, left)
        left -= bits
        at = lambda x: F.shiftrightunsigned(key(x), 20 * table + left).bitwiseAND((1 << bits) - 1)  # noqa: B023, E731 - used at once
        groups = F.flatten(F.transform(groups, lambda g: F.transform(F.sequence(_zero(), F.lit((1 << bits) - 1).cast("long")), lambda v: F.filter(g, lambda x: at(x) == v))))  # noqa: B023
    return groups


def cells(keys: Column, size: int) -> Column:
    """The three tables of a set, one after the other: array of (n, key, check)."""
    empty = F.struct(_zero().alias("n"), _zero().alias("key"), _zero().alias("check"))

    def cell(own: Column) -> Column:
        return F.aggregate(own, empty, lambda c, x: F.struct((c["n"] + 1).alias("n"), c["key"].bitwiseXOR(x).alias("key"), c["check"].bitwiseXOR(_check(x)).alias("check")))

    return F.concat(*[F.transform(_dealt(keys, table, size, lambda x: x), cell) for table in range(3)])


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(
        (x["n"] - y["n"]).alias("n"), x["key"].bitwiseXOR(y["key"]).alias("key"), x["check"].bitwiseXOR(y["check"]).alias("check")))


def peel(difference: Column, size: int) -> Column:
    """(left, found): cells that are not empty after peeling, and how many digests were recovered; complete if left is 0."""

    def pure(state: Column) -> Column:
        def single(n: int) -> Column:
            own = F.filter(state, lambda c: (c["n"] == n) & (_check(c["key"]) == c["check"]))
            # numbers are told apart by their hash, structs one by one
            return F.transform(F.array_distinct(F.transform(own, lambda c: c["key"])), lambda k: F.struct(F.lit(n).cast("long").alias("n"), k.alias("key")))

        return F.concat(single(1), single(-1))

    def without(state: Column, gone: Column) -> Column:
        def cell(c: Column, own: Column) -> Column:
            return F.when(F.size(own) == 0, c).otherwise(F.aggregate(own, c, lambda s, g: F.struct(
                (s["n"] - g["n"]).alias("n"), s["key"].bitwiseXOR(g["key"]).alias("key"), s["check"].bitwiseXOR(_check(g["key"])).alias("check"))))

        return F.zip_with(state, F.concat(*[_dealt(gone, table, size, lambda g: g["key"]) for table in range(3)]), cell)

    def step(s: Column, _: Column) -> Column:
        # the state of the round is bound once, as it is used twice
        rest = F.transform(F.array(without(s["cells"], s["next"])), lambda left: F.struct(left.alias("cells"), pure(left).alias("next"), (s["found"] + F.size(s["next"])).alias("found")))
        return F.when(F.size(s["next"]) == 0, s).otherwise(rest[0])

    # the difference is bound once as well
    return F.transform(F.array(difference), lambda d: F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(d.alias("cells"), pure(d).alias("next"), F.lit(0).alias("found")), step,
        lambda s: F.struct(F.size(F.filter(s["cells"], lambda c: (c["n"] != 0) | (c["key"] != 0))).alias("left"), s["found"].alias("found")),
    ))[0]


def with_likeness(df: DataFrame, out: str, a: str, b: str) -> DataFrame:
    """Adds ``out``, the likeness of the sketches of two digest columns: the share of common digests among all.

    Every try is a column of its own that looks only at the blocks that are still stuck.
    """
    blocks = F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2((F.size(a) + F.size(b)) / BLOCK_DIGESTS)))).cast("long")

    def of(keys: str, number: Column) -> Column:
        return F.filter(keys, lambda x: F.shiftrightunsigned(x, 44).bitwiseAND(F.col("_blocks") - 1) == number)

    def tried(p: Column, size: int) -> Column:
        return peel(subtract(cells(p["x"], size), cells(p["y"], size)), size)

    def first(p: Column) -> Column:
        return F.when(p["x"] == p["y"], F.struct(F.lit(0).alias("left"), F.lit(0).alias("found"))).otherwise(tried(p, TRIES[0]))

    def again(size: int):
        return lambda p, r: F.when(r["left"] == 0, r).otherwise(tried(p, size))

    def number(p: Column, r: Column) -> Column:
        # a block that no size could peel is compared as sets
        apart = F.size(F.array_except(p["x"], p["y"])) + F.size(F.array_except(p["y"], p["x"]))
        return F.when(r["left"] == 0, r["found"]).otherwise(apart)

    df = df.withColumn("_blocks", blocks)
    df = df.withColumn("_parts", F.transform(F.sequence(_zero(), F.col("_blocks") - 1), lambda i: F.struct(of(a, i).alias("x"), of(b, i).alias("y"))))
    df = df.withColumn("_tried", F.transform("_parts", first))
    for size in TRIES[1:]:
        df = df.withColumn("_tried", F.zip_with("_parts", "_tried", again(size)))
    apart = F.aggregate(F.zip_with("_parts", "_tried", number), F.lit(0), lambda n, x: n + x)
    both = F.size(a) + F.size(b)
    share = F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise((both - F.col("_apart")) / (both + F.col("_apart")))
    return df.withColumn("_apart", apart).withColumn(out, share).drop("_blocks", "_parts", "_tried", "_apart")


def fingerprint(keys: Column) -> Column:
    """The cells of the base size as text: count, digest and check of each cell in hexadecimal, with the number of digests in front."""
    def hexed(c: Column) -> Column:
        return F.concat(F.hex(c["n"]), F.lit("."), F.hex(c["key"]), F.lit("."), F.hex(c["check"]))

    return F.concat_ws(",", F.size(keys).cast("string"), F.transform(cells(keys, BASE), hexed))


def with_next(docs: DataFrame, order: str, carried: list[str]) -> DataFrame:
    """Adds ``next_<column>`` of the row that follows in the order of a long column; the last row gets the first one's."""
    spark = docs.sparkSession
    rows = docs.count()
    wanted = min(MOST_BUCKETS, max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), rows // BUCKET_ROWS), max(1, rows))
    shares = [i / wanted for i in range(wanted)]
    cuts = docs.agg(F.min(order), F.percentile_approx(order, F.lit(shares), F.lit(max(10_000, 10 * wanted)))).first()
    bounds = sorted({cuts[0], *(cuts[1] or [])} - {None}) or [0]
    # the bucket is found in two steps of about the square root of the number of buckets
    width = max(1, int(len(bounds) ** 0.5))
    heads = F.lit(bounds[::width]).cast("array<bigint>")
    chunks = F.array(*[F.lit(bounds[i : i + width]).cast("array<bigint>") for i in range(0, len(bounds), width)])
    at = F.col(order)
    head = F.size(F.filter(heads, lambda b: b <= at))
    bucket = (head - 1) * width + F.size(F.filter(F.element_at(chunks, head), lambda b: b <= at)) - 1
    placed = docs.withColumn("_bucket", bucket)
    opens = F.array_contains(F.element_at(chunks, head), at)
    before = F.when(F.col("_bucket") == 0, F.lit(len(bounds) - 1)).otherwise(F.col("_bucket") - 1)
    home = F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("guest"))
    both = F.when(opens, F.array(home, F.struct(before.alias("b"), F.lit(1).alias("guest")))).otherwise(F.array(home))
    spread = placed.withColumn("_in", F.explode(both)).select(*docs.columns, F.col("_in.b").alias("_b"), F.col("_in.guest").alias("_guest"))
    w = Window.partitionBy("_b").orderBy("_guest", order, *[c for c in carried])
    return spread.withColumns({f"next_{c}": F.lead(c).over(w) for c in carried}).filter("_guest = 0").drop("_b", "_guest")


def compare_edits(docs: DataFrame, bounded: bool = False) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of ``docs`` (doc_id, text)."""
    lowest = F.lit(-(1 << 63)).cast("long")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    read = read.withColumns({"_order": F.coalesce("doc_id", lowest), "keys": digests(F.col("text"), bounded)})
    pairs = with_next(read, "_order", ["text", "keys"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.length("text") - half), F.left("next_text", half))
    pairs = pairs.withColumn("edited", edited)
    pairs = pairs.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "keys", "next_keys", digests(F.col("edited"), bounded).alias("edited_keys"))
    pairs = with_likeness(with_likeness(pairs, "near_edited", "keys", "edited_keys"), "near_next", "keys", "next_keys")
    return pairs.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("keys")).alias("fingerprint"), fingerprint(F.col("edited_keys")).alias("edited_fingerprint"), "near_edited", "near_next"
    )
