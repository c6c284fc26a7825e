"""Tables and pre-tokens of a byte-level BPE vocabulary, shared by the encoder (op7) and the counter (op9).

The vocabulary is a tokenizers .json whose path is a parameter. The driver reads it and broadcasts its bytes
(a fixed file of a few MB); each Python worker builds its tables once.
"""

from __future__ import annotations

import json
import re
import zlib

import regex

from samplewell.llm.shared import kept

#: The pre-token pattern of byte-level BPE (public, from the tokenizers library's ByteLevel).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A space between two characters that are not white space always begins a pre-token.
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_DOUBLE = re.compile(r"\s\s")

_NEVER = 1 << 30

#: Entries in each of the two generations of a worker's cache.
CACHE = 200_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary's strings: itself if printable, else 256 + its rank."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in printable]
    return {chr(b if b in printable else 256 + rest.index(b)): b for b in range(256)}


class Vocabulary:
    """tokens: bytes of each id; ids: id of each byte string; pairs: (left, right) -> merged id; rank: merge order of an id; halves: the pair that an id is merged from."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model, alphabet = spec["model"], byte_alphabet()
        pre = spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or spec.get("normalizer") or pre.get("add_prefix_space"):
            raise ValueError("a byte-level BPE vocabulary without normalizer and prefix space is needed")
        self.ids = {bytes(alphabet[c] for c in s): i for s, i in model["vocab"].items()}
        self.tokens = {i: s for s, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        for s, i in self.special.items():
            self.tokens[i] = s.encode()
        self.byte_id = [self.ids[bytes([b])] for b in range(256)]
        self.pairs, self.rank, self.halves = {}, {}, {}
        to_id = model["vocab"]
        for k, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            left, right, whole = to_id[a], to_id[b], to_id[a + b]
            self.pairs[left, right] = whole
            if whole not in self.rank:
                self.rank[whole], self.halves[whole] = k, (left, right)
        self.pair_rank = {p: k for k, p in enumerate((to_id[a], to_id[b]) for a, b in ((m if isinstance(m, list) else m.split(" ")) for m in model["merges"]))}

    def merge(self, word: bytes) -> list[int]:
        """Textbook merging: the pair of least rank first, leftmost first among equals."""
        import heapq

        ids = [self.byte_id[b] for b in word]
        n = len(ids)
        if n < 2:
            return ids
        rank, pairs = self.pair_rank, self.pairs
        if n <= 64:
            ranks = [rank.get(p, _NEVER) for p in zip(ids, ids[1:])]
            while ranks and (best := min(ranks)) != _NEVER:
                k = ranks.index(best)
                ids[k : k + 2] = [pairs[ids[k], ids[k + 1]]]
                del ranks[k]
                if k:
                    ranks[k - 1] = rank.get((ids[k - 1], ids[k]), _NEVER)
                if k < len(ranks):
                    ranks[k] = rank.get((ids[k], ids[k + 1]), _NEVER)
            return ids
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(rank[p], k, *p) for k, p in enumerate(zip(ids, ids[1:])) if p in rank]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k]
            if j < 0 or ids[k] != a or ids[j] != b:
                continue
            ids[k], ids[j] = pairs[a, b], -1
            after[k] = after[j]
            if after[k] >= 0:
                before[after[k]] = k
                if (p := (ids[k], ids[after[k]])) in rank:
                    heapq.heappush(heap, (rank[p], k, *p))
            if before[k] >= 0 and (p := (ids[before[k]], ids[k])) in rank:
                heapq.heappush(heap, (rank[p], before[k], *p))
        return [i for i in ids if i >= 0]


def once(kind, raw: bytes, *more):
    """kind(raw, ...), made once for each worker process; what else it takes follows from raw."""
    key = kind.__name__, zlib.crc32(raw)
    if key not in kept:
        kept[key] = kind(raw, *more)
    return kept[key]


def chunks(text: str) -> list[str]:
    """Pieces of a text that pre-tokens never cross, each with its leading space; most are single words."""
    if " " not in text:
        return [text]
    if _DOUBLE.search(text) or text[0] == " " or text[-1] == " ":
        first, *rest = _SAFE_SPACE.split(text)
    else:
        first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]]


class Memo(dict):
    """make(key), kept for the last `most` to twice as many keys."""

    def __init__(self, make, most: int | None = None):
        super().__init__()
        self.make, self.old, self.most = make, {}, most or CACHE

    def __missing__(self, key):
        if (value := self.old.get(key)) is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


_find = regex.compile(PATTERN).findall


def pre_tokens(chunk: str) -> list[str]:
    return _find(chunk)
