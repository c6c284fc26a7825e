"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only.

Words are runs of letters and digits, lower-cased. A text's shingles are its runs of five words, an item of fewer words
is one shingle of its own length. Every window of a document that is as long as an item is looked at, whatever its start: a running
count tells how many of its shingles occur in any item of that length. Similarity s asks for s (m + window) / (1 + s) common
shingles, so that windows with fewer such shingles cannot pass with any item; all others get a 64-bit SimHash of all their
shingles, in which every occurrence counts. BLOCKS blocks of bits index the items' fingerprints: two fingerprints within
RADIUS differ by at most RADIUS div BLOCKS bits in one block at least, and each item is listed under every value that near, so that
equi-joins on the blocks find all of them. At similarity 0.8 the expected distance is about 10 of 64 bits with a deviation of 3,
so that RADIUS lies more than three deviations above. Candidates are then compared exactly by weighted Jaccard (the weight of a
shingle is its number of occurrences: sum of the lesser counts over sum of the greater).
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplewell.llm.shared import cut, once

#: Words in a shingle, least similarity, Hamming radius, blocks of the fingerprint.
WORDS, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 19, 5
#: Tables of at most so many rows are broadcast (shingles of items: 16 bytes each; index rows: some 60); longer ones are joined by a shuffle.
BROADCAST_SHINGLES, BROADCAST_INDEX, BROADCAST_ROWS = 2_000_000, 500_000, 500_000
#: Tasks among which the rows of one shingle are spread in that shuffle.
SALTS = 16

_WIDE, _EXTRA = divmod(64, BLOCKS)
#: First bit and width of each block, the wider ones first.
PLACES = [(k * _WIDE + min(k, _EXTRA), _WIDE + (k < _EXTRA)) for k in range(BLOCKS)]


def _word_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.xxhash64(w))


def _shingles(words: Column, size: int) -> Column:
    """All shingles of `size` words, in order, as hashes; words: word hashes that are already computed."""
    n = F.size(words)
    at = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(F.lit(size), *[F.get(words, i + k) for k in range(size)]))
    return F.when(n >= size, at).otherwise(F.array().cast("array<bigint>"))


def _simhash(window: str) -> Column:
    """Bit b is 1 if more occurrences of shingles have bit b set than not."""
    return F.expr(
        f"aggregate(sequence(0, 63), 0L, (s, b) -> s | shiftleft(CASE WHEN aggregate({window}, 0, (a, h) -> a + 2 * CAST(getbit(h, b) AS INT) - 1) > 0 THEN 1L ELSE 0L END, b))"
    )


def _block(fingerprint: str, at: int, width: int) -> str:
    return f"(shiftrightunsigned({fingerprint}, {at}) & {(1 << width) - 1}L)"


def _values(near: int) -> Column:
    """(block, value) of a fingerprint's blocks; near: all values that differ from the block by at most so many bits."""

    def values(k: int, at: int, width: int) -> Column:
        masks = [sum(1 << b for b in bits) for r in range(near + 1) for bits in combinations(range(width), r)]
        value = F.expr(_block("fingerprint", at, width))
        return F.transform(F.array(*map(F.lit, masks)).cast("array<bigint>"), lambda m: F.struct(F.lit(k).alias("block"), value.bitwiseXOR(m).alias("value")))

    return F.concat(*[values(k, *place) for k, place in enumerate(PLACES)])


def _near() -> int:
    """Index rows of an item."""
    return sum(comb(width, r) for _, width in PLACES for r in range(RADIUS // BLOCKS + 1))


def _first_block(x: str) -> Column:
    """The first block in which two fingerprints are near enough; x: their exclusive or."""
    return F.coalesce(*[F.when(F.bit_count(F.expr(_block(x, at, width))) <= RADIUS // BLOCKS, F.lit(k)) for k, (at, width) in enumerate(PLACES)])


def _shared(item: str, window: str) -> Column:
    """Sum over shingles of the lesser number of occurrences."""
    plain = F.size(F.array_intersect(item, window))
    counted = F.expr(f"aggregate(array_distinct({item}), 0, (a, h) -> a + least(size(filter({item}, x -> x = h)), size(filter({window}, x -> x = h))))")
    return F.when(F.size(F.array_distinct(item)) == F.size(item), plain).otherwise(counted)


def items_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(item_id, size, m, shingles, fingerprint) of every item that has words."""
    def sized(w: Column) -> Column:
        size = F.least(F.size(w), F.lit(words))
        return F.struct(size.alias("size"), F.coalesce(*[F.when(size == k, _shingles(w, k)) for k in range(1, words + 1)]).alias("shingles"))

    rows = benchmark.select(F.col(id_col).cast("bigint").alias("item_id"), once(_word_hashes(F.col(text_col)), sized).alias("x")).select("item_id", "x.size", "x.shingles").where("size > 0")
    rows = rows.distinct()
    return cut(rows.select("item_id", "size", F.size("shingles").alias("m"), "shingles", _simhash("shingles").alias("fingerprint")))


def leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """One row per document id and benchmark item that it contains: id, item_id, similarity (of the best window), start_word (the first best window).

    Null, empty and short texts match as far as their words go: a document shorter than an item is one window. Repeated
    ids are one document. Null ids and null item ids are ids like others. Items without words match nothing. An empty
    table on either side gives no rows. Other columns of the inputs are left out.
    """
    items = items_of(benchmark, words=words)
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    totals = items.groupBy("size").agg(F.count("*").alias("items"), F.sum("m").alias("shingles")).collect()  # at most `words` rows
    sizes = sorted(r["size"] for r in totals)
    if sizes:
        dense = _dense_starts(docs, items, sizes, similarity, sum(r["shingles"] for r in totals) <= BROADCAST_SHINGLES)
        found = _matches(_windows(docs, dense, sizes), items, similarity, sum(r["items"] for r in totals))
    else:
        found = df.sparkSession.createDataFrame([], "id bigint, item_id bigint, similarity double, start int")
    best = F.max_by(F.struct("similarity", "start"), F.struct(F.col("similarity"), -F.col("start")))
    return found.groupBy("id", "item_id").agg(best.alias("b")).select(F.col("id").alias(id_col), "item_id", F.round("b.similarity", 6).alias("similarity"), F.col("b.start").cast("bigint").alias("start_word"))


def _dense_starts(docs: DataFrame, items: DataFrame, sizes: list[int], similarity: float, few: bool) -> DataFrame:
    """(id, t, windows): the (size, m, start) of all windows of each text that hold enough shingles of the benchmark; t: a hash of the text."""
    known = items.select(F.explode("shingles").alias("h"), "size", "m").distinct()
    listed = lambda w: F.flatten(F.array(*[F.transform(_shingles(w, k), lambda h, i: F.struct(i.alias("p"), h.alias("h"))) for k in sizes]))
    hashed = docs.select("id", "t", once(_word_hashes(F.col("text")), lambda w: F.struct(F.size(w).alias("words"), listed(w).alias("s"))).alias("x"))
    hashed = hashed.select("id", "t", "x.words", "x.s")  # before it is exploded: what lies beside it is copied for each shingle
    # The outer form and no filter before it: pushed down, one would compute the words anew for each shingle.
    at = hashed.select("id", "t", "words", F.explode_outer("s").alias("s")).select("id", "t", "words", "s.p", "s.h")
    if few:
        hits = at.join(F.broadcast(known), "h")
    else:
        hits = at.withColumn("salt", F.pmod(F.xxhash64("id", "p"), F.lit(SALTS)).cast("int")).join(known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["h", "salt"])
    by = hits.groupBy("id", "t", "size", "m").agg(F.first("words").alias("words"), F.array_sort(F.collect_set("p")).alias("at"))  # at most a text's words
    by = by.withColumn("n", F.col("words") - F.col("size") + 1)
    need = F.ceil(F.lit(similarity) * (F.col("m") + F.least("m", "n")) / (1 + similarity) - 1e-9).cast("int")
    by = by.withColumn("need", F.greatest(F.lit(1), need)).where("size(at) >= need")
    # Hit i and the need - 1 after it lie in the windows that start from at[i + need - 1] - m + 1 to at[i].
    runs = F.expr("""filter(transform(slice(at, 1, size(at) - need + 1), (a, i) -> struct(greatest(0, at[i + need - 1] - m + 1) AS low, least(a, greatest(0, n - m)) AS high)), x -> x.low <= x.high)""")
    starts = F.array_distinct(F.flatten(F.transform(runs, lambda r: F.sequence(r["low"], r["high"]))))
    rows = by.select("id", "t", F.transform(starts, lambda s: F.struct("size", "m", s.alias("start"))).alias("w")).where("size(w) > 0")
    return cut(rows.groupBy("id", "t").agg(F.flatten(F.collect_list("w")).alias("windows")))


def _windows(docs: DataFrame, dense: DataFrame, sizes: list[int]) -> DataFrame:
    """(id, m, size, start, window, fingerprint) of the dense windows."""
    same = docs["id"].eqNullSafe(dense["id"]) & (docs["t"] == dense["t"])
    rows = docs.join(F.broadcast(dense) if dense.count() <= BROADCAST_ROWS else dense, same).select(docs["id"], "text", "windows")
    shingled = once(_word_hashes(F.col("text")), lambda w: F.array(*[_shingles(w, k) for k in sizes]))
    rows = cut(rows.select("id", shingled.alias("s"), "windows"))  # written, or the shingles would be made anew for each window
    rows = rows.select("id", "s", F.explode("windows").alias("x"))
    size = F.coalesce(*[F.when(F.col("x.size") == k, F.lit(j)) for j, k in enumerate(sizes)])
    rows = rows.select("id", "x.size", "x.m", "x.start", F.slice(F.get("s", size), F.col("x.start") + 1, F.col("x.m")).alias("window")).distinct()
    return cut(rows.withColumn("fingerprint", _simhash("window")))


def _matches(windows: DataFrame, items: DataFrame, similarity: float, n: int) -> DataFrame:
    index = items.select("item_id", "size", "m", F.col("fingerprint").alias("own"), F.explode(_values(RADIUS // BLOCKS)).alias("b")).select("item_id", "size", "m", "own", "b.block", "b.value")
    index = F.broadcast(index) if n * _near() <= BROADCAST_INDEX else index
    keyed = windows.withColumn("b", F.explode(_values(0))).select("id", "size", "m", "start", "window", "fingerprint", "b.block", "b.value")
    pairs = keyed.join(index, ["size", "m", "block", "value"]).withColumn("x", F.expr("fingerprint ^ own")).where((F.bit_count("x") <= RADIUS) & (_first_block("x") == F.col("block")))
    texts = items.select("item_id", "size", "shingles", F.col("fingerprint").alias("own"), F.col("m"))
    same = pairs["item_id"].eqNullSafe(texts["item_id"]) & (pairs["own"] == texts["own"]) & (pairs["size"] == texts["size"]) & (pairs["m"] == texts["m"])
    both = pairs.join(texts, same).select("id", pairs["item_id"], "start", "window", "shingles").withColumn("both", _shared("shingles", "window"))
    sim = F.col("both") / (F.size("shingles") + F.size("window") - F.col("both"))
    return both.select("id", "item_id", sim.alias("similarity"), "start").where(F.col("similarity") >= similarity)
