"""BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a pre-token there is exactly one last token in its BPE encoding. An automaton over the vocabulary
(goto and fail links: the states are the longest vocabulary-prefix suffixes of what was read) lists the tokens that are
suffixes of the prefix, longest first; the first that is compatible with the unique last token of the prefix before it
is the prefix's own. Two tokens are compatible if merging their joined bytes would give just these two, which follows from
the merge ranks along their inner split edges alone. Back-pointers from the whole word give the ids. Time grows with the
pre-token's length, not its square, so long runs are safe.
"""

from __future__ import annotations

import hashlib
from collections import deque

import numpy as np
from pyspark.sql import DataFrame

from samplewell.llm import shared
from samplewell.llm.bpe import Memo, Vocabulary, chunks, default_path, once, pre_tokens


class Codec:
    def __init__(self, raw: bytes, cache: int | None = None):
        v = self.vocabulary = once(Vocabulary, raw)
        merged = {i: s for i, s in v.tokens.items() if i not in v.special.values() and (len(s) == 1 or i in v.rank)}
        self._build({s: i for i, s in merged.items()})
        self._fits: dict[int, bool] = {}
        self.length = [0] * (max(merged) + 1)
        for i, s in merged.items():
            self.length[i] = len(s)
        self.by_text = {str(i): s for i, s in v.tokens.items()}
        self.words, self.chunks = Memo(self._word_text, cache), Memo(self._chunk, cache)

    def _build(self, words: dict[bytes, int]) -> None:
        step, end, fail, depth = {}, [-1], [0], 1
        for s, i in words.items():
            at = 0
            for b in s:
                key = at << 8 | b
                nxt = step.get(key)
                if nxt is None:
                    nxt = step[key] = depth
                    depth += 1
                    end.append(-1)
                    fail.append(0)
                at = nxt
            end[at] = i
        below: list[list[tuple[int, int]]] = [[] for _ in range(depth)]
        for key, nxt in step.items():
            below[key >> 8].append((key & 255, nxt))
        longest, shorter, queue = end[:], [-1] * (max(words.values()) + 1), deque([0])  # longest: longest token that ends at a state; shorter: next one that is a suffix of a token
        while queue:
            at = queue.popleft()
            for b, nxt in below[at]:
                f = fail[at]
                while at and f and (f << 8 | b) not in step:
                    f = fail[f]
                fail[nxt] = step.get(f << 8 | b, 0) if at else 0
                if end[nxt] >= 0:
                    shorter[end[nxt]] = longest[fail[nxt]]
                else:
                    longest[nxt] = longest[fail[nxt]]
                queue.append(nxt)
        self.step, self.fail, self.longest, self.shorter, self.moves = step, fail, longest, shorter, dict(step)

    def fits(self, left: int, right: int) -> bool:
        """Whether the encoding of the joined bytes is these two tokens.

        The tokens meet at one border. Undo the later of the two innermost merges at that border again and again; if at
        any time the two pieces that touch it form a merge that comes before the merges that made the pieces vanish, the
        border would not have survived.
        """
        v = self.vocabulary
        rank, halves, pair_rank = v.rank, v.halves, v.pair_rank
        a, b, limit = left, right, 1 << 40
        while True:
            if pair_rank.get((a, b), 1 << 40) < limit:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            # At equal rank the left one was merged first, so the right piece is undone first.
            if ra > rb:
                # (x, b) with x the right half of a must lose to the merge that made a: it must not come before ra.
                limit, a = ra, halves[a][1]
            else:
                limit, b = rb + 1, halves[b][0]

    def word(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        moves, longest, shorter, length, known = self.moves, self.longest, self.shorter, self.length, self._fits
        last, at, end = [0], 0, 0
        for b in data:
            end += 1
            key = at << 8 | b
            at = moves[key] if key in moves else self._move(key)
            token = longest[at]
            before = end - length[token]
            while before:
                pair = last[before] << 20 | token
                if known[pair] if pair in known else self._known(pair):
                    break
                token = shorter[token]
                before = end - length[token]
            last.append(token)
        out = []
        while end:
            out.append(last[end])
            end -= length[last[end]]
        return out[::-1]

    def _move(self, key: int) -> int:
        """The state after a byte that the goto links lack at this state: by its fail links, kept for the next time."""
        at, b = key >> 8, key & 255
        nxt = None
        while nxt is None and at:
            at = self.fail[at]
            nxt = self.step.get(at << 8 | b)
        if len(self.moves) < 3 * len(self.step):
            self.moves[key] = nxt or 0
        return nxt or 0

    def _known(self, pair: int) -> bool:
        if len(self._fits) > 400_000:
            self._fits.clear()
        ok = self._fits[pair] = self.fits(pair >> 20, pair & 0xFFFFF)
        return ok

    def _word_text(self, word: str) -> str:
        return ",".join(map(str, self.word(word.encode())))

    def _chunk(self, chunk: str) -> str:
        words = pre_tokens(chunk)  # a chunk that is one pre-token is kept as a chunk alone
        return self._word_text(chunk) if len(words) == 1 else ",".join(map(self.words.__getitem__, words))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids))

    def encode(self, text: str) -> list[int]:
        return numbers(self.listed(text)).tolist()

    def listed(self, text: str) -> str:
        """The ids of a whole text, in decimal and joined by commas."""
        v, ids = self.vocabulary, []
        for part in v.special_split.split(text) if v.special_split and any(s in text for s in v.special) else [text]:
            if part in v.special:
                ids.append(str(v.special[part]))
            elif part:
                ids += map(self.chunks.__getitem__, chunks(part))
        return ",".join(ids)

    def digest(self, text: str) -> tuple[int, str, str]:
        return self.digest_of(self.listed(text))

    def digest_of(self, listed: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids, SHA-256 of the text decoded from them."""
        ids = listed.split(",") if listed else []
        back = b"".join(map(self.by_text.__getitem__, ids)).decode("utf-8", "replace")
        return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def numbers(listed: str) -> np.ndarray:
    """The numbers of a comma-joined list."""
    return np.fromstring(listed, np.int64, sep=",") if listed else np.empty(0, np.int64)


def _vocabulary(df: DataFrame, path: str | None):
    with open(path or default_path(), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ids (array<bigint>). Null and empty texts give no ids. Repeated rows and null ids stay; other columns are left out."""
    raw = _vocabulary(df, path)

    def run(codec, keys, texts):
        return [keys, [numbers(codec.listed(t or "")) for t in texts]]

    return shared.map_columns(df.select(df[id_col].cast("bigint"), df[text_col]), run, f"{id_col} bigint, ids array<bigint>", lambda: once(Codec, raw.value), keep=True)


def decode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: id, text. Null and empty lists give the empty text; ids outside the vocabulary are skipped, as are null ids in a list."""
    raw = _vocabulary(df, path)

    def run(codec, keys, ids):
        known = codec.vocabulary.tokens
        return [keys, [codec.decode([i for i in x or [] if i in known]).decode("utf-8", "replace") for x in ids]]

    return shared.map_columns(df.select(df[id_col].cast("bigint"), df[ids_col]), run, f"{id_col} bigint, text string", lambda: once(Codec, raw.value), keep=True)


def digests(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, cache: int | None = None) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256, through a real encode and decode of the whole text; with_ids adds ids; cache: entries of a worker's
    caches, which trade memory for time.

    Null and empty texts have no ids. Repeated rows and null ids stay; other columns are left out.
    """
    raw = _vocabulary(df, path)

    def run(codec, keys, texts):
        listed = [codec.listed(t or "") for t in texts]
        found = [codec.digest_of(x) for x in listed]
        out = [keys, [x[0] for x in found], [x[1] for x in found], [x[2] for x in found]]
        return [*out, list(map(numbers, listed))] if with_ids else out

    schema = f"{id_col} bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<bigint>" * with_ids
    return shared.map_columns(df.select(df[id_col].cast("bigint"), df[text_col]), run, schema, lambda: once(Codec, raw.value, cache), keep=True)
