"""Exact n-gram Jaccard join by filtering under several global token orders.

A document is the set of its distinct word shingles (64-bit hashes); every text is split and hashed once, and documents with
equal sets are one class from the start. Under any global order of the tokens, two sets with Jaccard >= t share one of their
first n - ceil(t n) + 1 tokens. The orders here put rare tokens first: a fixed part of the hash space is the pool; its
tokens are counted over all distinct sets and come first, by frequency and then by a hash that differs between the orders.
Tokens of frequency 1 fill most prefixes and match nothing, so most documents drop out before any join. Sets whose prefix is not filled
by rare pool tokens are read again: their other tokens come next, by frequency among these sets, and the pool's common
tokens last, so that a passage that many documents share hardly ever gets into a prefix. Candidates must share a prefix
token under every order; then the sets are compared exactly.

A prefix token that many sets share would make a square of candidates. Each such bucket gets a hub h, and each member x is
compared with it: A = x minus h and D = h minus x are its edits E. Two members with s common edits have
|x & y| = |h| - d_x - d_y + s and |x | y| = |h| + a_x + a_y - s, so that they link if and only if
s >= (W_x + W_y - K) / (num + den) with W = num a + den d and K = (den - num) |h|. Members with W <= K link with the hub
and need no comparison with each other. All other pairs are found by prefixes of the edits, rarest first, whose lengths
follow from the bounds of W of both sides' classes. Buckets of edits that are still large get hubs of their own.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplewell.llm.graph import components
from samplewell.llm.shared import map_columns, mark, release, spread_join, table, tidy
from samplewell.llm.textkit import WordHashes, shingles

#: The pool's part of the token hash space is so many times the part of a set that its prefix takes.
POOL = 2
#: The orders: what the hash is seeded with that breaks ties.
SEEDS = (0, 1, 2)
#: Pool tokens of so many sets come last in every order.
HOT_DF = 64
#: Buckets of more members are compared through a hub.
SMALL_BUCKET = 64
#: Buckets of edits of two classes are compared at once where one side has at most so many members.
FEW = 16
#: Id lists up to this length (16 MB) are broadcast; longer ones are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def _signature(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


class _Seen:
    """A task's word table, and the sets it has had: an exact copy in the same task brings no tokens."""

    def __init__(self):
        self.table, self.sets = WordHashes(), set()

    def new(self, sig: int) -> bool:
        if sig in self.sets:
            return False
        if len(self.sets) >= 100_000:
            self.sets.clear()
        self.sets.add(sig)
        return True


def document_sets(df: DataFrame, size: int, edge: float, id_col: str, text_col: str) -> DataFrame:
    """(id, n, sig, tokens): the number of distinct shingles, the set's signature (null without words), and its tokens in the pool (null without an id or words, and for a set that the task has had)."""
    most = np.uint64(min(2**64 - 1, int(edge * 2**64)))

    def run(state, ids, texts):
        n, sigs, tokens = [], [], []
        for i, t in zip(ids, texts):
            s = shingles(t or "", size, state.table)
            sig = _signature(s) if len(s) else None
            n.append(len(s))
            sigs.append(sig)
            tokens.append(s[: np.searchsorted(s, most)].view(np.int64) if sig is not None and i is not None and state.new(sig) else None)
        return [ids, n, sigs, tokens]

    return map_columns(df.select(F.col(id_col).cast("bigint"), F.col(text_col)), run, "id bigint, n bigint, sig bigint, tokens array<bigint>", _Seen)


def _part_of(texts: DataFrame, ids: DataFrame, size: int, edge: float) -> DataFrame:
    """(sig, tokens) of the sets of the listed ids, once each: their tokens from a part of the hash space on (0: all)."""
    least = np.uint64(min(2**64 - 1, int(edge * 2**64)))
    wanted = ids.select("id").distinct()
    wanted = F.broadcast(wanted) if ids.count() <= BROADCAST_IDS else wanted

    def run(words, found):
        sets = [shingles(t or "", size, words) for t in found]
        return [[_signature(s) if len(s) else None for s in sets], [s[np.searchsorted(s, least) :].view(np.int64) for s in sets]]

    sets = map_columns(texts.join(wanted, "id", "left_semi").select("text"), run, "sig bigint, tokens array<bigint>", WordHashes)
    return table(sets.where("sig is not null").groupBy("sig").agg(F.first("tokens").alias("tokens")))


def _shared_tokens(sets: DataFrame) -> DataFrame:
    """(sig, f): for each set (sig, tokens) that has any, its tokens that other sets have as well, as (df, token)."""
    rows = sets.select("sig", F.explode("tokens").alias("token"))
    counts = table(rows.groupBy("token").agg(F.count("*").alias("df")).where("df >= 2"))
    return spread_join(rows, counts, ["token"], "df").groupBy("sig").agg(F.collect_list(F.struct("df", "token")).alias("f"))


def _none(kind: str = "array<struct<df:bigint,token:bigint>>") -> Column:
    return F.array().cast(kind)


def _in_order(f: str, seed: int) -> Column:
    """The tokens of column f by frequency, then by a hash."""
    by = F.sort_array(F.transform(f, lambda x: F.struct(x["df"], F.xxhash64(x["token"], F.lit(seed)).alias("h"), x["token"].alias("token"))))
    return F.transform(by, lambda x: x["token"])


def _first(tokens: Column, k: Column) -> Column:
    return F.slice(tokens, F.lit(1), F.greatest(F.lit(0), k).cast("int"))


def prefixes(reps: DataFrame, texts: DataFrame, size: int, num: int, den: int, edge: float) -> DataFrame:
    """(sig, id, n, first, second, third): the shared tokens of each set's prefix under the three orders, for sets that have any."""
    p = F.expr(f"n - (n * {num} + {den - 1}) div {den} + 1")
    rows = reps.select("sig", "id", "n", "pool").join(_shared_tokens(reps), "sig", "left").withColumn("f", F.coalesce("f", _none()))
    rows = rows.withColumn("left", p - F.col("pool") + F.size("f"))
    rows = rows.where("left > 0")  # else tokens of frequency 1 fill the prefix
    rows = rows.withColumn("rare", F.filter("f", lambda x: x["df"] < HOT_DF)).withColumn("hot", F.filter("f", lambda x: x["df"] >= HOT_DF)).drop("f")
    rows = table(rows)
    enough = F.col("left") <= F.size("rare")
    names = ["first", "second", "third"]
    plain = rows.where(enough).select("sig", "id", "n", *[_first(_in_order("rare", s), F.col("left")).alias(c) for s, c in zip(SEEDS, names)])
    needy = rows.where(~enough)
    outside = _part_of(texts, needy.select("id"), size, edge).join(needy.select("sig"), "sig", "left_semi")
    full = needy.join(_shared_tokens(outside), "sig", "left").withColumn("f", F.coalesce("f", _none()))
    full = full.withColumn("left", F.col("left") - F.size("rare") - (F.col("n") - F.col("pool") - F.size("f")))  # what rare pool tokens and those that no other such set has leave
    order = lambda s: F.concat(_in_order("rare", s), _first(_in_order("f", s), F.col("left")), _first(_in_order("hot", s), F.col("left") - F.size("f")))
    full = full.select("sig", "id", "n", *[order(s).alias(c) for s, c in zip(SEEDS, names)])
    return table(plain.union(full).where("size(first) > 0"))


def _filtered(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) that share a prefix token under each of the further orders too."""
    x = found.select(F.col("sig").alias("a"), F.col("second").alias("x2"), F.col("third").alias("x3"))
    y = found.select(F.col("sig").alias("b"), F.col("second").alias("y2"), F.col("third").alias("y3"))
    return pairs.join(x, "a").join(y, "b").where(F.arrays_overlap("x2", "y2") & F.arrays_overlap("x3", "y3")).select(*pairs.columns)


def _pairs_of_small(members: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs (a, b) of each bucket (token, sig, n) of at most SMALL_BUCKET members that pass the length filter."""
    by = members.groupBy("token").agg(F.sort_array(F.collect_list(F.struct("n", "sig"))).alias("m"))
    longer = lambda x, i: F.filter(F.slice("m", i + 2, F.lit(SMALL_BUCKET)), lambda y: x["n"] * den >= y["n"] * num)
    pairs = F.flatten(F.transform("m", lambda x, i: F.transform(longer(x, i), lambda y: F.struct(F.least(x["sig"], y["sig"]).alias("a"), F.greatest(x["sig"], y["sig"]).alias("b")))))
    return by.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that link, by comparing the whole sets."""
    left, right = sets.toDF("a", "xs"), sets.toDF("b", "ys")
    both = F.size(F.array_intersect("xs", "ys"))
    return pairs.join(left, "a").join(right, "b").withColumn("i", both).where(F.col("i") * den >= (F.size("xs") + F.size("ys") - F.col("i")) * num).select("a", "b")


def _edits(buckets: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(hub, sig, w, k, linked, edits) for each member of the buckets (key, sig, size) and the hub of its bucket: the member that is in most buckets."""
    popular = buckets.join(buckets.groupBy("sig").agg(F.count("*").alias("in")), "sig")
    hubs = table(popular.groupBy("key").agg(F.max(F.struct("in", "sig")).alias("m"), F.first("size").alias("size")).select("key", F.col("m.sig").alias("hub"), "size"))
    near = table(spread_join(buckets.drop("size"), hubs, ["key"], "size").where("hub <> sig").select("hub", "sig").distinct())
    sizes = near.groupBy("hub").agg(F.count("*").alias("members"))
    hub_sets = table(sizes.join(sets.select(F.col("sig").alias("hub"), F.col("tokens").alias("h")), "hub"))
    both = spread_join(near, hub_sets, ["hub"], "members").join(sets, "sig").withColumn("added", F.array_except("tokens", "h")).withColumn("missing", F.array_except("h", "tokens"))
    w, k = num * F.size("added") + den * F.size("missing"), (den - num) * F.size("h")
    return table(both.select("hub", "sig", w.alias("w"), k.alias("k"), (w <= k).alias("linked"), F.concat("added", "missing").alias("edits")))


def _edit_keys(edits: DataFrame, num: int, den: int) -> DataFrame:
    """(key, sig, hub, high): a key for each pair of classes and each shared edit in the prefix that this pair of classes asks for.

    Classes 0 to 3 cut the W of members that link with the hub, 0 to K, those from 4 on what is beyond, in steps of K / 4.
    """
    rows = edits.select("hub", "sig", F.explode("edits").alias("token"))
    counts = table(rows.groupBy("hub", "token").agg(F.count("*").alias("df")).where("df >= 2"))
    shared = spread_join(rows, counts, ["hub", "token"], "df").groupBy("hub", "sig").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("f"))
    own = edits.select("hub", "sig", "w", "k", F.size("edits").alias("e")).join(shared, ["hub", "sig"])
    both = num + den
    own = own.withColumn("step", F.expr("greatest(1, k div 4)")).withColumn("class", F.expr("IF(w <= k, (4 * w) div (k + 1), 4 + (w - k - 1) div step)"))
    # Partner classes: at least one of the two is beyond the hub's links, and neither side has fewer edits than they must share.
    last = F.expr(f"4 + (e * {both} - w - 1) div step")
    own = own.withColumn("other", F.explode(F.sequence(F.when(F.col("class") < 4, F.lit(4)).otherwise(F.lit(0)).cast("bigint"), F.greatest(F.lit(4), last).cast("bigint"))))
    own = own.withColumn("low", F.expr("IF(other < 4, (other * (k + 1) + 3) div 4, k + 1 + (other - 4) * step)")).withColumn("top", F.expr("IF(other < 4, ((other + 1) * (k + 1) + 3) div 4, k + 1 + (other - 3) * step)"))
    own = own.withColumn("need", F.expr(f"greatest(1, (w + low - k + {both - 1}) div {both})")).where(F.expr(f"need <= e and need * {num} <= top"))
    own = own.withColumn("token", F.explode(_first(F.col("f"), F.expr("e - need + 1 - (e - size(f))")))).select("hub", "sig", "class", "other", F.col("token.token").alias("token"))
    key = F.xxhash64("hub", F.least("class", "other"), F.greatest("class", "other"), "token")
    side = F.when(F.col("class") < F.col("other"), 0).when(F.col("class") > F.col("other"), 1)
    return own.select(key.alias("key"), "sig", "hub", side.alias("side"))


def _pairs_of_edits(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (hub, a, b) of the buckets that make few, and the members (key, sig, size) of the others.

    A bucket of two classes has pairs across its sides only: few if one side has at most FEW members. They are listed, and the other side meets the list.
    """
    sizes = keys.groupBy("key").agg(F.count("*").alias("size"), F.count("side").alias("sided"), F.coalesce(F.sum("side"), F.lit(0)).alias("high"))
    lower = F.least("high", F.col("size") - F.col("high"))
    sizes = sizes.where((F.col("size") >= 2) & ((F.col("sided") == 0) | (lower > 0)))
    listed = F.when(F.col("sided") == 0, F.when(F.col("size") <= SMALL_BUCKET, -1)).when(lower <= FEW, (F.col("high") <= F.col("size") - F.col("high")).cast("int"))
    sizes = table(sizes.select("key", "size", listed.alias("listed")))  # which side is listed; -1: all members; null: too many
    members = table(spread_join(keys.withColumn("side", F.coalesce("side", F.lit(-1))), sizes, ["key"], "size"))
    lists = members.where(F.col("side") == F.col("listed")).groupBy("key", "size").agg(F.collect_list("sig").alias("sigs"))
    others = members.where(F.col("listed").isNotNull() & ((F.col("listed") == -1) | (F.col("side") != F.col("listed")))).select("key", "hub", "sig")
    pairs = spread_join(others, table(lists), ["key"], "size").select("hub", "sig", F.explode("sigs").alias("o")).where("o <> sig")
    pairs = pairs.select("hub", F.least("sig", "o").alias("a"), F.greatest("sig", "o").alias("b")).distinct()
    return pairs, members.where("listed is null").select("key", "sig", "size").distinct()


def _across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose sets are not in one component yet."""
    x, y = roots.toDF("a", "x_root"), roots.toDF("b", "y_root")
    both = pairs.join(x, "a", "left").join(y, "b", "left")
    return both.where(F.coalesce("x_root", "a") != F.coalesce("y_root", "b")).select(*pairs.columns)


def _verified_edits(pairs: DataFrame, edits: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (hub, a, b) that link, by their common edits."""
    x = edits.select("hub", F.col("sig").alias("a"), "k", F.col("w").alias("xw"), F.col("edits").alias("xs"))
    y = edits.select("hub", F.col("sig").alias("b"), F.col("w").alias("yw"), F.col("edits").alias("ys"))
    both = pairs.join(x, ["hub", "a"]).join(y, ["hub", "b"])
    return both.where(F.size(F.array_intersect("xs", "ys")) * (num + den) >= F.col("xw") + F.col("yw") - F.col("k")).select("a", "b")


def jaccard_components(df: DataFrame, size: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id: the least id reachable by links (den * |A & B| >= num * |A | B|).

    Null and empty texts and texts of white space have an empty set and link with nothing: their component is their own id.
    Rows with a null id are kept, are linked with nothing, and have a null component. Repeated rows are links like any
    equal sets; rows that share an id share a component only if their sets link. Shingles are compared as 64-bit hashes.
    """
    edge = min(1.0, POOL * (den - num) / den)
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    texts = docs.where("id is not null")
    since, read = mark(), table(document_sets(docs, size, edge, "id", "text"))
    with_tokens = read.where("tokens is not null").groupBy("sig").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    reps = table(with_tokens.select("sig", "id", "n", F.size("tokens").cast("bigint").alias("pool"), "tokens"))
    listed = table(read.select("id", "n", "sig"))
    release(df.sparkSession, since, 1)  # the tokens of all rows
    named = listed.where("id is not null and sig is not null")
    found = prefixes(reps, texts, size, num, den, edge)
    tidy(df.sparkSession)

    postings = found.select("sig", "n", F.explode("first").alias("token"))
    sizes = table(postings.groupBy("token").agg(F.count("*").alias("size")).where("size >= 2"))
    members = table(spread_join(postings, sizes, ["token"], "size"))
    pairs = table(_filtered(_pairs_of_small(members.where(F.col("size") <= SMALL_BUCKET), num, den), found))
    large = members.where(F.col("size") > SMALL_BUCKET).select(F.col("token").alias("key"), "sig", "size")
    needed = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).union(large.select("sig")).distinct()
    sets = _part_of(texts, table(found.join(needed, "sig", "left_semi").select("id")), size, 0.0)
    links = table(_verified(pairs, sets, num, den))
    roots = table(components(links))
    while not large.isEmpty():  # a bucket loses its hub at least, and hardly ever is one of edits still large
        edits = _edits(large, sets, num, den)
        joined = edits.where("linked").select(F.col("hub").alias("a"), F.col("sig").alias("b"))
        roots = table(components(_chain(roots).union(joined)))
        pairs, large = _pairs_of_edits(_edit_keys(edits, num, den))
        more = table(_verified_edits(_filtered(_across(pairs, roots), found), edits, num, den))
        if not more.isEmpty():
            roots = table(components(_chain(roots).union(more)))

    # Classes of equal sets, then components of classes.
    classes = named.groupBy("sig").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    classes = table(classes.join(roots.toDF("sig", "root"), "sig", "left").where("copies > 1 or root is not null").select("sig", F.coalesce("root", "sig").alias("root"), "least", "copies"))
    least = classes.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("size"))
    named_as = table(spread_join(classes, least, ["root"], "size").select("sig", "component", "copies"))
    out = spread_join(listed.where("sig is not null").select("id", "n", "sig"), named_as, ["sig"], "copies", "left").select("id", "n", "component")
    out = out.union(listed.where("sig is null").select("id", "n", F.lit(None).cast("bigint")))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
    )


def _chain(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
