"""One-permutation MinHash fingerprints with optimal densification and packed low-order bits.

Each shingle hash goes to one of BINS bins once; a bin keeps its least hash. An empty bin takes the value of the first
non-empty bin in its own fixed random sequence of bins (the same for all documents), so that two sets fill an empty bin
alike with the probability of their similarity. BITS low-order bits of each bin are packed; two fingerprints that agree
in a share s of bins have likeness (s - 2^-BITS) / (1 - 2^-BITS), cut to 0..1, since unrelated bins agree by chance.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewell.llm.shared import map_columns
from samplewell.llm.textkit import WordHashes, mix, shingles

#: Production parameters: words in a shingle, bins, stored bits of a bin.
WORDS, BINS, BITS = 5, 512, 4
#: Neighbour search: rows in a bucket of consecutive ids, about.
BUCKET_ROWS = 256
#: Ranges of ids found by quantiles, and buckets at most (the driver lists one id for each).
RANGES, MOST_BUCKETS = 512, 1_000_000


class Sketcher:
    def __init__(self, words: int = WORDS, bins: int = BINS, bits: int = BITS):
        if bins & (bins - 1) or 8 % bits:
            raise ValueError("bins: a power of 2; bits: 1, 2, 4 or 8")
        self.words, self.bins, self.bits, self.table = words, bins, bits, WordHashes()
        self.shift = np.uint64(64 - bins.bit_length() + 1)
        self._turns: dict[int, np.ndarray] = {}

    def _turn(self, k: int) -> np.ndarray:
        """The k-th 16 bins that each bin tries when it is empty."""
        if k not in self._turns:
            with np.errstate(over="ignore"):
                seed = np.arange(16, dtype=np.uint64)[:, None] + np.uint64(16 * k)
                at = np.arange(self.bins, dtype=np.uint64)[None, :]
                self._turns[k] = (mix(seed * np.uint64(0x9E3779B97F4A7C15) + mix(at + np.uint64(1))) >> self.shift).astype(np.int64)
        return self._turns[k]

    def sketch(self, text: str) -> np.ndarray | None:
        """Low bits of each bin; None without words."""
        tokens = shingles(text, self.words, self.table)
        if not len(tokens):
            return None
        bins = (tokens >> self.shift).astype(np.int64)
        first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])  # tokens are sorted, and the bin is their high part: the first is the least
        value = np.zeros(self.bins, np.uint64)
        value[bins[first]] = tokens[first]
        if len(first) == 1:
            value[:] = tokens[first[0]]
        elif len(first) < self.bins:
            full = np.zeros(self.bins, bool)
            full[bins[first]] = True
            empty, k = np.flatnonzero(~full), 0
            while len(empty):
                tries = self._turn(k)[:, empty]
                hit = full[tries]
                at = hit.argmax(0)
                found = hit[at, np.arange(len(empty))]
                value[empty[found]] = value[tries[at, np.arange(len(empty))][found]]
                empty, k = empty[~found], k + 1
        return (mix(value) & np.uint64((1 << self.bits) - 1)).astype(np.uint8)

    def pack(self, low: np.ndarray | None) -> str:
        """Hex of the packed bits, first bin in the high bits; the empty string without words."""
        if low is None:
            return ""
        per = 8 // self.bits
        out = np.zeros(self.bins // per, np.uint8)
        for j in range(per):
            out |= low[j::per] << np.uint8(8 - self.bits * (j + 1))
        return out.tobytes().hex()

    def unpack(self, packed: str) -> np.ndarray | None:
        if not packed:
            return None
        data, per = np.frombuffer(bytes.fromhex(packed), np.uint8), 8 // self.bits
        out = np.empty(self.bins, np.uint8)
        for j in range(per):
            out[j::per] = data >> np.uint8(8 - self.bits * (j + 1)) & np.uint8((1 << self.bits) - 1)
        return out

    def likeness(self, a: np.ndarray | None, b: np.ndarray | None) -> float:
        """Estimated Jaccard similarity; two texts without words are alike (1), one without is unlike any other (0)."""
        if a is None or b is None:
            return float(a is b)
        chance = 0.5**self.bits
        return min(1.0, max(0.0, (float((a == b).mean()) - chance) / (1 - chance)))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint of its whole text. Null is the empty text, whose fingerprint is the empty string.

    Repeated rows and null ids stay; equal texts have equal fingerprints; other columns are left out.
    """

    def run(sketcher, ids, texts):
        return [ids, [sketcher.pack(sketcher.sketch(t or "")) for t in texts]]

    return map_columns(df.select(F.col(id_col).cast("bigint"), F.col(text_col)), run, f"{id_col} bigint, fingerprint string", Sketcher)


def edited(text: str, following: str) -> str:
    """The last third of the text's code points, replaced by the first as many (or all) of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def edit_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness to each other and to the next row's.

    Rows are in descending order of id (nulls last, equal ids by a hash of the text, then the text); the next row of the last
    is the first. Any BIGINT is an id like others. Consecutive ids are dealt to buckets by range, an id that many rows share by the
    hash; each bucket also gets the first row of the bucket that follows, and each task goes through its sorted buckets row by
    row: nothing is gathered. Beyond MOST_BUCKETS buckets of BUCKET_ROWS rows the buckets grow, and nothing is lost. Null texts are empty. No rows give no rows; a single row
    is its own next row; other columns are left out.
    """
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    ids = docs.select("id")
    total, low, high = ids.agg(F.count("*"), F.min("id"), F.max("id")).first()
    pieces = max(1, min(MOST_BUCKETS, total // BUCKET_ROWS))
    # Bucket numbers rise as ids fall, and as hashes rise where a range is one id; null ids come last.
    ranges = min(pieces, RANGES)
    parts = -(-pieces // ranges)
    bounds = []
    if low is not None:
        cuts = [int(c) for c in ids.where("id is not null").stat.approxQuantile("id", [k / ranges for k in range(1, ranges)], 0.2 / ranges)] if ranges > 1 else []
        alone = {c - 1 for c in cuts if cuts.count(c) > 1}  # an id that fills a range has one of its own
        bounds = [low - 1, *sorted({c for c in {*cuts, *alone} if low <= c < high}), high]
    bucket = _bucket(F.col("id"), F.col("hash"), bounds, parts)
    placed = docs.withColumn("bucket", bucket)
    firsts = placed.groupBy("bucket").agg(F.max("id").alias("id")).select("bucket", "id").collect()  # one row a bucket: at most MOST_BUCKETS pairs of numbers
    order = sorted(firsts, key=lambda r: r["bucket"])
    # The first row of each bucket is also wanted at the end of the bucket before it (cyclically).
    before = [(order[k]["bucket"], order[k]["id"], order[k - 1]["bucket"]) for k in range(len(order))]
    heads = df.sparkSession.createDataFrame(before, "bucket bigint, head bigint, target bigint")
    extra = placed.join(F.broadcast(heads), (placed["bucket"] == heads["bucket"]) & placed["id"].eqNullSafe(heads["head"])).groupBy("target").agg(F.min(F.struct("hash", "text")).alias("first")).select("target", "first.hash", "first.text")
    rows = placed.select("bucket", "id", "hash", "text", F.lit(0).alias("last")).union(extra.select("target", F.lit(None).cast("bigint"), "hash", "text", F.lit(1)))
    rows = rows.repartition(F.col("bucket")).sortWithinPartitions(F.col("bucket"), F.col("last"), F.col("id").desc_nulls_last(), F.col("hash"), F.col("text"))

    def run(state, buckets, ids, texts, last):
        sketcher, held = state["sketcher"], state["held"]
        out = []
        for b, i, t, end in zip(buckets, ids, texts, last):
            mine = sketcher.sketch(t)
            if held is not None:
                i0, t0, s0 = held
                new = edited(t0, t)
                s1 = s0 if new == t0 else sketcher.sketch(new)
                out.append((i0, len(t0), hashlib.sha256(new.encode()).hexdigest(), sketcher.pack(s0), sketcher.pack(s1), sketcher.likeness(s0, s1), sketcher.likeness(s0, mine)))
            held = None if end else (i, t, mine)
        state["held"] = held
        return [list(c) for c in zip(*out)] if out else [[] for _ in range(7)]

    return map_columns(
        rows.select("bucket", "id", "text", "last"), run,
        f"{id_col} bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
        lambda: {"sketcher": Sketcher(), "held": None},
    )


def _bucket(col, hashed, bounds: list[int], parts: int):
    """Ids fall into ranges between bounds (found by nested CASEs), and evenly into parts of a range; a range of one id, and that of nulls, is parted by the hash. All in DOUBLE, where no difference of ids overflows."""
    ranges = max(0, len(bounds) - 1)
    part = lambda share: F.greatest(F.lit(0).cast("bigint"), F.least(F.lit(parts - 1).cast("bigint"), F.floor(share * parts)))
    by_hash = part(hashed.cast("double") / F.lit(2.0**64) + 0.5)

    def search(a: int, b: int):
        if b - a == 1:
            width = bounds[b] - bounds[a]
            return F.lit((ranges - b) * parts).cast("bigint") + (by_hash if width == 1 else part((F.lit(float(bounds[b])) - col.cast("double")) / F.lit(float(width))))
        m = (a + b) // 2
        return F.when(col <= F.lit(bounds[m]), search(a, m)).otherwise(search(m, b))

    nulls = F.lit(ranges * parts).cast("bigint") + by_hash
    return F.when(col.isNull(), nulls).otherwise(search(0, ranges)) if ranges else nulls
