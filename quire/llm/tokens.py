"""Corpus encoding with a public byte-level BPE vocabulary: speculate and verify.

Method: a text is cut into words by the vocabulary's split pattern. Of each
distinct word, greedy longest match proposes tokens; a vectorised check then
tests every adjacent pair of proposed tokens. A proposal is the exact BPE
encoding if (and only if) each token is its own encoding and each adjacent pair
is compatible, that is, no merge across the seam would have come before the
merges that built its two sides. Only words with a failing pair go through
exact merging.

Nulls and empty texts give the empty list; every other text, whatever its
length, is encoded whole. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Words whose encodings a worker keeps; older ones go first.
CACHE_WORDS = 400_000


def default_vocabulary() -> str:
    """Path of the public byte_bpe_50k rank file installed on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def split_pattern() -> str:
    """The public pattern that cuts text into words before merging."""
    import public_tokenizers

    return public_tokenizers.PATTERN


class SpeculativeEncoder:
    """Exact BPE encoder of one rank file (token id = rank)."""

    def __init__(self, path: str, pattern: str | None = None):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.words = regex.compile(pattern or split_pattern())
        self.longest = max(map(len, self.ranks))
        size = max(self.bytes_of) + 1
        # The two tokens whose merge forms each token; bytes point to themselves.
        self.left = np.arange(size, dtype=np.int64)
        self.right = np.arange(size, dtype=np.int64)
        # A token is usable in a proposal only if merging its bytes gives it back.
        self.own = np.zeros(size, dtype=bool)
        for token, rank in self.ranks.items():
            if len(token) == 1:
                self.own[rank] = True
                continue
            parts = self._merge(token, rank)
            if len(parts) == 2:
                self.left[rank], self.right[rank] = parts
                self.own[rank] = True
        self.atom = self.left == np.arange(size)
        merged = np.array([t for t in range(size) if self.own[t] and not self.atom[t]], dtype=np.int64)
        keys = (self.left[merged] << 32) | self.right[merged]
        order = np.argsort(keys)
        self.pair_keys, self.pair_rank = keys[order], merged[order]
        self.usable = {b: r for b, r in self.ranks.items() if self.own[r]}
        #: Longest usable token by first byte, to keep the greedy search short.
        self.reach = [0] * 256
        for b in self.usable:
            self.reach[b[0]] = max(self.reach[b[0]], len(b))
        self.cache: dict[str, tuple[int, ...]] = {}

    def _merge(self, word: bytes, below: int | None = None) -> list[int]:
        """Exact merging: always the adjacent pair of least rank (under `below`), leftmost first."""
        parts = [word[i : i + 1] for i in range(len(word))]
        if len(parts) > 64:
            return self._merge_long(parts, below)
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None or (below is not None and best >= below):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _merge_long(self, parts: list[bytes], below: int | None) -> list[int]:
        """The same for long words, in n log n by a heap over linked parts."""
        import heapq

        ranks, n = self.ranks, len(parts)
        after, before, text = list(range(1, n + 1)), list(range(-1, n - 1)), list(parts)
        heap = []

        def push(i: int) -> None:
            j = after[i]
            if j < n and (r := ranks.get(text[i] + text[j])) is not None and (below is None or r < below):
                heapq.heappush(heap, (r, i, len(text[i]), len(text[j])))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if text[i] else n
            if j >= n or len(text[i]) != a or len(text[j]) != b:
                continue
            text[i], text[j] = text[i] + text[j], b""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [ranks[t] for t in text if t]

    def _propose(self, word: bytes) -> list[int]:
        out, i, n, usable, reach = [], 0, len(word), self.usable, self.reach
        while i < n:
            for j in range(min(n, i + reach[word[i]]), i, -1):
                r = usable.get(word[i:j])
                if r is not None:
                    out.append(r)
                    i = j
                    break
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether both stay as they are when side by side.

        Both sides are taken apart from the seam outwards, the later merge first;
        the pair fails as soon as the two pieces at the seam would have merged
        before the piece just taken apart was built.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        good = np.ones(len(a), dtype=bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        live = np.arange(len(a))
        while len(live):
            x, y, top = a[live], b[live], limit[live]
            key = (x << 32) | y
            at = np.searchsorted(self.pair_keys, key)
            at[at == len(self.pair_keys)] = 0
            hit = (self.pair_keys[at] == key) & (self.pair_rank[at] < top)
            good[live[hit]] = False
            keep = ~hit
            live, x, y = live[keep], x[keep], y[keep]
            done = self.atom[x] & self.atom[y]
            live, x, y = live[~done], x[~done], y[~done]
            # Take the younger side apart; bytes cannot be.
            left_first = ~self.atom[x] & (self.atom[y] | (x > y))
            limit[live] = np.where(left_first, x, y + 1)
            a[live] = np.where(left_first, self.right[x], x)
            b[live] = np.where(left_first, y, self.left[y])
        return good

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Encodings of distinct words."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        proposals = [self._propose(w) for w in raw]
        lengths = np.fromiter((len(p) for p in proposals), dtype=np.int64, count=len(proposals))
        if not lengths.sum():
            return [tuple(p) for p in proposals]
        flat = np.concatenate([np.asarray(p, dtype=np.int64) for p in proposals if p])
        owner = np.repeat(np.arange(len(proposals)), lengths)
        inner = owner[1:] == owner[:-1]
        bad = owner[1:][inner][~self.compatible(flat[:-1][inner], flat[1:][inner])]
        for i in np.unique(bad):
            proposals[i] = self._merge(raw[i])
        return [tuple(p) for p in proposals]

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; the empty list for null and empty ones."""
        split = [self.words.findall(t) if t else () for t in texts]
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        new = list({w for ws in split for w in ws if w not in cache})
        cache.update(zip(new, self.encode_words(new)))
        out = []
        for ws in split:
            ids: list[int] = []
            for w in ws:
                ids += cache[w]
            out.append(ids)
        return out


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> SpeculativeEncoder:
    """One encoder for each vocabulary and worker process."""
    return SpeculativeEncoder(path)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, ids): token ids of each row's text, in the row's own task, without a shuffle.

    Repeated rows each give their row; a null key stays null. `vocabulary` is a
    path that must exist on every executor.
    """
    path = vocabulary or default_vocabulary()
    source = df.select(df[key], df[text])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in batches:
            texts = [t if isinstance(t, str) else None for t in pdf.iloc[:, 1]]
            yield pd.DataFrame({key: pdf.iloc[:, 0], "ids": enc.encode_batch(texts)})

    schema = T.StructType([T.StructField(key, source.schema[0].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return source.mapInPandas(run, schema)
