"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first: case, accents, look-alike letters of other scripts, and digits and signs that stand for letters
inside words. The lexicon is learned from labelled texts: whole words, and stems (beginnings of words), that toxic texts
have far more often than others; an entry's weight is its log odds. Phrases of a lexicon entry and a neighbouring word that
occur in clean texts only are exceptions, whose matches don't count. The sum of the weights and the sum over the text's length
are turned into a probability by a logistic function, fitted on the same sample.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewell.llm.shared import cut, map_columns

#: Labelled texts of a class in the fitting sample, at most about; least toxic texts for an entry, as a number and as a share.
SAMPLE, LEAST, SHARE = 3000, 3, 0.02
#: Lengths of stems; least share of toxic texts among those that have an entry (classes weighted alike); least clean texts for an exception.
STEMS, PURITY, LEAST_CLEAN = (4, 5, 6, 7), 0.8, 3
#: A word with this share of a stem's toxic texts brings them alone.
ALONE = 0.9
THRESHOLD = 0.7

#: Letters of other scripts that look like Latin ones.
LOOK_ALIKE = dict(zip("абвгеёіїјкӏмнорстухѕԁԛԝһցαβεικνορτυχγωℓıɡ", "abbreeiijklmhopctyxsdqwhgabeiknoptuxywlig", strict=True))
#: Digits and signs read as letters inside words.
AS_LETTER = dict(zip("0134578@$!|", "oleastbasll", strict=True))
#: Letters that the digit 1 may stand for are one letter.
ONE = str.maketrans("l", "i")

_INSIDE = re.compile(r"(?<=[a-z])[0134578@$!|]+(?=[a-z])|(?<![a-z0-9])[0134578@$](?=[a-z]{2})|(?<=[a-z]{2})[0134578@$]+(?![a-z0-9@$])")
_HAS = re.compile(r"[0134578@$!|]")
_REST = str.maketrans(dict.fromkeys("0123456789@$!|", " "))
_TO_LETTERS = str.maketrans(AS_LETTER)


class _Fold(dict):
    """Code point -> what it is folded to, made when first met: a letter, a digit or sign that may be one, or a space."""

    def __missing__(self, code: int) -> str:
        c = chr(code).lower()
        plain = "".join(LOOK_ALIKE.get(x, x) for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        value = plain if plain and all(x.isalnum() or x in AS_LETTER for x in plain) else "" if code in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD) or unicodedata.combining(chr(code)) else " "
        self[code] = value
        return value


_fold = _Fold()


def fold(text: str) -> str:
    """Words of folded letters, parted by spaces, with a space at both ends."""
    s = text.translate(_fold)
    if _HAS.search(s):
        s = _INSIDE.sub(lambda m: m[0].translate(_TO_LETTERS), s)
    return f" {' '.join(s.translate(_REST).split())} ".translate(ONE)


class Lexicon:
    """entries: ' word ' or ' stem' -> weight; exceptions: two-word phrases that don't count; model: intercept and two slopes."""

    def __init__(self, entries: dict[str, float], exceptions: frozenset[str] = frozenset(), model=(0.0, 0.0, 0.0)):
        self.entries, self.exceptions, self.model, self._automaton = entries, exceptions, model, None

    def __getstate__(self):
        return {"entries": self.entries, "exceptions": self.exceptions, "model": self.model, "_automaton": None}

    def _ready(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for e, w in self.entries.items():
                self._automaton.add_word(e, (e, w))
            self._automaton.make_automaton()
        return self._automaton

    def hits(self, folded: str) -> list[tuple[float, str, str]]:
        """Weight and the two phrases (with the word before, with the word after) of each matched word; the heaviest entry counts for a word."""
        if not self.entries:
            return []
        best: dict[int, float] = {}
        for end, (e, w) in self._ready().iter(folded):
            at = end - len(e) + 2
            best[at] = max(w, best.get(at, 0.0))
        out = []
        for at, w in sorted(best.items()):
            stop = folded.index(" ", at)
            word = folded[at:stop]
            before = folded[folded.rfind(" ", 0, max(0, at - 1)) + 1 : at - 1] if at > 1 else ""
            after = folded[stop + 1 : folded.find(" ", stop + 1)] if stop + 1 < len(folded) else ""
            out.append((w, f"{before} {word}", f"{word} {after}"))
        return out

    def features(self, folded: str) -> tuple[float, float]:
        total = distinct_weight(self.hits(folded), self.exceptions)
        words = max(1, folded.count(" ") - 1)
        return math.log1p(total), math.log1p(100 * total / words)

    def score(self, text: str | None) -> float:
        if not self.entries:
            return 0.0
        a, b, c = self.model
        x, y = self.features(fold(text or ""))
        z = a + b * x + c * y if x else min(a, -2.0)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def distinct_weight(hits, exceptions) -> float:
    """Sum of the weights of the matched words, each word once; a word counts if any of its places is no exception."""
    return sum({x.rpartition(" ")[2]: w for w, x, y in hits if x not in exceptions and y not in exceptions}.values())


def _terms(folded: str) -> set[str]:
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in STEMS if len(w) > k}


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton's method with a small ridge; slopes are kept from falling below 0."""
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        ridge = np.diag([1e-6, 0.05, 0.05])
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge + 1e-9 * np.eye(3), a.T @ (p - y) + ridge @ w)
    w[1:] = np.maximum(w[1:], 0)
    return tuple(map(float, w))


def learn(df: DataFrame, labels: DataFrame, allowed, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Lexicon:
    """A lexicon from a bounded sample of the labelled documents; allowed: a condition on the id. No labels give an empty lexicon.

    Null labels, and others than 0 and 1, are no labels; of conflicting labels of one id the greater counts. Null texts and null ids teach nothing.
    """
    rows = labels.where(allowed & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    totals = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    share = F.when(F.col("y") == 1, F.lit(min(1.0, SAMPLE / totals.get(1, 1)))).otherwise(F.lit(min(1.0, SAMPLE / totals.get(0, 1))))
    sample = rows.where(F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 20)) < share * (1 << 20)).limit(3 * SAMPLE)
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(sample), "id").select("text", F.col("y").cast("int").alias("y"))

    def count(_, texts, ys):
        toxic, clean = Counter(), Counter()
        for t, y in zip(texts, ys):
            (toxic if y else clean).update(_terms(fold(t)))
        terms = [*toxic.keys() | clean.keys()]
        n = sum(ys)
        return [["", *terms], [n, *[toxic[t] for t in terms]], [len(ys) - n, *[clean[t] for t in terms]]]

    counted = map_columns(texts, count, "term string, toxic bigint, clean bigint").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counted = cut(counted.where((F.col("toxic") >= LEAST) | (F.col("term") == "")))
    nt, nc = next(((r["toxic"], r["clean"]) for r in counted.where("term = ''").collect()), (0, 0))
    if not nt or not nc:
        return Lexicon({})
    # What can be an entry, or the word that alone brings a stem: by the shares, at most the mean number of terms of a toxic text over ALONE * SHARE.
    t, c = F.col("toxic") / nt, F.col("clean") / nc
    best = counted.where((F.col("term") != "") & (F.col("toxic") >= ALONE * SHARE * nt) & (t >= ALONE * PURITY * (t + c))).collect()
    by = {r["term"]: (r["toxic"], r["clean"]) for r in best}
    entries: dict[str, float] = {}
    purity = lambda t, c: (t / nt) / (t / nt + c / nc)
    # Entries that more toxic texts have come first; what a kept stem covers is left out, as are stems that one word alone brings.
    alone: dict[str, int] = {}
    for term, (t, _) in by.items():
        for k in STEMS if term.endswith(" ") else ():
            alone[term[: k + 1]] = max(t, alone.get(term[: k + 1], 0))
    for term, (t, c) in sorted(by.items(), key=lambda x: (-x[1][0], len(x[0]), x[0])):
        if t < SHARE * nt or purity(t, c) < PURITY or any(term[:k] in entries for k in range(5, len(term))):
            continue
        if not term.endswith(" ") and alone.get(term, 0) >= ALONE * t:
            continue
        entries[term] = min(8.0, math.log((t + 0.5) / (nt + 1)) - math.log((c + 0.5) / (nc + 1)))
    first = Lexicon(entries)

    def matched(_, texts, ys):
        out = [first.hits(f) for f in map(fold, texts)]
        return [[y for y in ys], [max(1, fold(t).count(" ") - 1) for t in texts], ["|".join(f"{w!r};{a};{b}" for w, a, b in hits) for hits in out]]

    found = map_columns(texts, matched, "y int, words bigint, hits string").collect()  # the sample is bounded, and so is a text's list of hits by its length
    parsed = [(r["y"], r["words"], [(float(w), a, b) for w, a, b in (h.split(";") for h in r["hits"].split("|") if h)]) for r in found]
    toxic, clean = Counter(), Counter()
    for y, _, hits in parsed:
        (toxic if y else clean).update({p for h in hits for p in h[1:]})
    exceptions = frozenset(p for p, n in clean.items() if n >= LEAST_CLEAN and not toxic[p])
    x = [[math.log1p(s := distinct_weight(hits, exceptions)), math.log1p(100 * s / words)] for _, words, hits in parsed]
    return Lexicon(entries, exceptions, _fit(np.array(x), np.array([p[0] for p in parsed], float)))


def toxicity(df: DataFrame, lexicon: Lexicon, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score (0 to 1), predicted (1 if score >= THRESHOLD), from the whole text alone.

    Null and empty texts score as texts without a match; with nothing learned all score 0. Repeated rows and null ids stay;
    other columns are left out.
    """
    shared = df.sparkSession.sparkContext.broadcast(lexicon)  # short strings: the entries, which the share of toxic texts bounds, and the exceptions met in the sample

    def run(lex, ids, texts, held):
        scores = [lex.score(t) for t in texts]
        return [ids, held, scores, [int(s >= THRESHOLD) for s in scores]]

    return map_columns(df.select(F.col(id_col).cast("bigint"), F.col(text_col), held_out), run, f"{id_col} bigint, held_out boolean, score double, predicted int", lambda: shared.value)
