"""Token counts by the whole-token shortcut.

Offline, once, on the driver, each vocabulary string is encoded by itself; those that are one pre-token and come back as their own single
token are proved whole. A pre-token that equals one of them counts 1 without any merging; only the rest is merged. The proved strings (less than the vocabulary, some 600 kB) are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from samplewell.llm import shared
from samplewell.llm.bpe import Memo, Vocabulary, chunks, default_path, once, pre_tokens


class Counter:
    def __init__(self, raw: bytes, whole: frozenset[str] | None = None):
        v = self.vocabulary = once(Vocabulary, raw)
        self.whole = prove_whole(v) if whole is None else whole
        self.words, self.chunk = Memo(self._merged), Memo(self._chunk)

    def _merged(self, word: str) -> int:
        return len(self.vocabulary.merge(word.encode()))

    def _chunk(self, chunk: str) -> int:
        whole, words = self.whole, self.words
        return sum(1 if w in whole else words[w] for w in pre_tokens(chunk))

    def count(self, text: str) -> int:
        v = self.vocabulary
        if not text:
            return 0
        if v.special_split is None or not any(s in text for s in v.special):
            return sum(map(self.chunk.__getitem__, chunks(text)))
        return sum(1 if p in v.special else sum(map(self.chunk.__getitem__, chunks(p))) for p in v.special_split.split(text) if p)


def prove_whole(v: Vocabulary) -> frozenset[str]:
    """Vocabulary strings that alone are one pre-token and encode to their own single id."""
    out = []
    for s, i in v.ids.items():
        try:
            text = s.decode()
        except UnicodeDecodeError:  # half a character is never a pre-token
            continue
        if pre_tokens(text) == [text] and v.merge(s) == [i]:
            out.append(text)
    return frozenset(out)


def token_counts(df: DataFrame, path: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows and null ids stay; other columns are left out.
    Special strings inside a text count as their one special token, as the library does by default.
    """
    with open(path or default_path(), "rb") as f:
        raw = f.read()
    table = df.sparkSession.sparkContext.broadcast((raw, prove_whole(once(Vocabulary, raw))))

    def run(counter, keys, texts):
        n = [counter.count(t) if t else 0 for t in texts]
        return [keys, [len(t.encode()) if t else 0 for t in texts], n, [x > limit for x in n]]

    return shared.map_columns(df.select(df[id_col].cast("bigint"), df[text_col]), run, f"{id_col} bigint, n_bytes bigint, n_tokens bigint, over_limit boolean", lambda: once(Counter, *table.value), keep=True)
