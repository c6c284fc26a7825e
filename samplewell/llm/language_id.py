"""Language identification by a byte convolutional network, trained and applied in numpy.

A text is lower-cased and cut into windows of WINDOW bytes. Filters of several widths read one-hot bytes: a filter has a
weight for each byte value at each of its places. The greatest response over the window (at least 0) is pooled, and a softmax
layer over the pooled responses gives the languages. A text's probabilities are the mean over all its windows.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewell.llm.shared import filter_rows, map_columns

#: Bytes in a window, filter widths, filters of each width.
WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
#: Training: a sample of at most about SAMPLE texts of each language, PIECES windows of each; steps, batch, learning rate.
SAMPLE, PIECES, STEPS, BATCH, RATE = 400, 2, 260, 48, 0.02
#: Windows of a step of prediction.
STEP = 64

_LETTER = regex.compile(r"\p{L}")


def windows(text: str) -> np.ndarray:
    """All windows of a text, the last one filled up with zeros."""
    data = np.frombuffer(text.lower().encode(), np.uint8)
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = data
    return out.reshape(n, WINDOW)


class Network:
    """tables[w][i]: weights (256, FILTERS) of the byte at place i of the filters of the w-th width."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = [[rng.normal(0, 0.3, (256, FILTERS)).astype(np.float32) for _ in range(w)] for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)
        self._pairs = None

    def _forward(self, x: np.ndarray):
        pooled, places = [], []
        for tables, bias in zip(self.tables, self.bias):
            n = x.shape[1] - len(tables) + 1
            r = tables[0][x[:, :n]]
            for i in range(1, len(tables)):
                r += tables[i][x[:, i : i + n]]
            at = r.argmax(1)
            pooled.append(np.take_along_axis(r, at[:, None, :], 1)[:, 0] + bias)
            places.append(at)
        h = np.concatenate(pooled, 1)
        return h, places

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 7) -> None:
        """Adam on the cross-entropy; the gradient of a maximum goes to the place that has it."""
        rng = np.random.default_rng(seed)
        groups = [np.flatnonzero(y == k) for k in range(len(self.languages))]
        params = [*[t for ts in self.tables for t in ts], *self.bias, self.out, self.out_bias]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            rows = np.concatenate([rng.choice(g, max(1, batch // len(groups))) for g in groups if len(g)])
            xb, yb = x[rows], y[rows]
            h, places = self._forward(xb)
            a = np.maximum(h, 0)
            d = self._softmax(a @ self.out + self.out_bias)
            d[np.arange(len(yb)), yb] -= 1
            d /= len(yb)
            grads_out = [a.T @ d, d.sum(0)]
            dh = (d @ self.out.T) * (h > 0)
            grads, biases = [], []
            lanes = np.broadcast_to(np.arange(FILTERS), (len(yb), FILTERS))
            for k, (tables, at) in enumerate(zip(self.tables, places)):
                g = dh[:, k * FILTERS : (k + 1) * FILTERS]
                for i in range(len(tables)):
                    t = np.zeros_like(tables[i])
                    np.add.at(t, (np.take_along_axis(xb, at + i, 1), lanes), g)
                    grads.append(t)
                biases.append(g.sum(0))
            scale = rate * min(1.0, 3 * (1 - step / (steps + 1)))
            for p, g, mm, vv in zip(params, [*grads, *biases, *grads_out], m, v):
                mm += 0.1 * (g - mm)
                vv += 0.01 * (g * g - vv)
                p -= scale * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-6)

    def _ready(self):
        """For prediction, the weights of two neighbouring bytes are added up in one table of byte pairs."""
        if self._pairs is None:
            self._pairs = [
                [(a + 0, (tables[a][:, None, :] + tables[a + 1][None, :, :]).reshape(65536, FILTERS)) for a in range(0, len(tables) - 1, 2)]
                + ([(len(tables) - 1, tables[-1])] if len(tables) % 2 else [])
                for tables in self.tables
            ]
        return self._pairs

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of each window."""
        groups, out = self._ready(), []
        for s in range(0, len(x), STEP):
            xb = x[s : s + STEP].astype(np.int32)
            pair = xb[:, :-1] << 8 | xb[:, 1:]
            pooled = []
            for parts, bias, w in zip(groups, self.bias, WIDTHS):
                n, r = x.shape[1] - w + 1, None
                for at, table in parts:
                    t = table[(pair if len(table) > 256 else xb)[:, at : at + n]]
                    r = t if r is None else np.add(r, t, out=r)
                pooled.append(r.max(1) + bias)
            a = np.maximum(np.concatenate(pooled, 1), 0)
            out.append(self._softmax(a @ self.out + self.out_bias))
        return np.concatenate(out)

    def texts(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and its mean probability over all windows of each text; `und` and 0 for a text without a letter."""
        has = [bool(t) and _LETTER.search(t) is not None for t in texts]
        if not any(has) or not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        cuts = [windows(t) for t, ok in zip(texts, has) if ok]
        p = self.predict(np.concatenate(cuts))
        ends = np.cumsum([len(c) for c in cuts])
        mean = np.add.reduceat(p, np.r_[0, ends[:-1]], axis=0) / np.array([len(c) for c in cuts])[:, None]
        best, at, lang, score = mean.argmax(1), 0, [], []
        for ok in has:
            lang.append(self.languages[best[at]] if ok else "und")
            score.append(float(min(1.0, mean[at, best[at]])) if ok else 0.0)
            at += ok
        return lang, score


def train(df: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network:
    """A network from a bounded sample of the labelled rows for which `learn` is true."""
    known = df.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), learn.alias("learn")).where("learn and lang is not null and text is not null")
    counts = known.groupBy("lang").count().collect()  # one row a language
    languages = sorted(r["lang"] for r in counts)
    net = Network(languages)
    if not languages:
        return net
    share = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(min(1.0, SAMPLE / r["count"]))) for r in counts])
    length = F.char_length("text")
    piece = [F.substr("text", (1 + F.pmod(F.xxhash64("h", F.lit(k)), F.greatest(F.lit(1), length - WINDOW // 2))).cast("int"), F.lit(WINDOW)) for k in range(PIECES)]
    rows = known.where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20)).select("h", "lang", *[p.alias(f"p{k}") for k, p in enumerate(piece)])
    rows = sorted(rows.limit(2 * SAMPLE * len(languages)).collect())
    pieces = [(windows(r[f"p{k}"])[0], languages.index(r["lang"])) for r in rows for k in range(PIECES)]
    if pieces:
        net.train(np.stack([p[0] for p in pieces]), np.array([p[1] for p in pieces]))
    return net


def identify(df: DataFrame, net: Network, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score, from the whole text alone.

    Ties between languages go to the first by name. `und` with score 0 for null, empty and letterless texts, and for all texts if nothing could be learned. Repeated rows and
    null ids stay; other columns are left out.
    """
    model = df.sparkSession.sparkContext.broadcast(net)  # some 150 kB

    def run(state, ids, texts, held):
        lang, score = state.texts(texts)
        return [ids, held, lang, score]

    return map_columns(df.select(F.col(id_col).cast("bigint"), F.col(text_col), held_out), run, f"{id_col} bigint, held_out boolean, lang_pred string, score double", lambda: model.value)


def of_known_language(df: DataFrame, net: Network, least: float, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text has a letter and a learned language with a score of `least` or more. Each row is judged by its text alone."""
    model = df.sparkSession.sparkContext.broadcast(net)

    def fits(state, texts):
        lang, score = state.texts(texts)
        return [x != "und" and s >= least for x, s in zip(lang, score)]

    return filter_rows(df, fits, text_col, lambda: model.value)
