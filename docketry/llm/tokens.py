"""Problem 6: encode a whole corpus with a public byte-level BPE tokenizer.

Texts of an Arrow batch are laid out as one array of code points. Pre-token boundaries and two polynomial fingerprints of
every pre-token come from a few vector operations over that array. Tier one is a minimal perfect hash over the vocabulary
(levels of bitmaps with ranks): it turns a fingerprint into the only slot the token could have, and the fingerprints stored
there confirm it. Tier two, for pre-tokens that are no vocabulary entry, merges bytes with a heap over a linked list;
results are remembered per worker up to a fixed number of entries.

The vocabulary has a fixed size (50 257 entries); each Python worker reads it from the path given and never ships it.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Code points Unicode calls White_Space.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Endings that split off after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
MEMO = 400_000
CHUNK = 1 << 21


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[WHITE_SPACE] = SPACE
    return table


@lru_cache(2)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    up = np.full(n, base, np.uint64)
    down = np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def fingerprints(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit polynomial hashes of each points[start:end], by prefix sums."""
    n, out = len(points), []
    size = 1 << max(10, int(n - 1).bit_length() if n > 1 else 1)
    with np.errstate(over="ignore"):
        for b in BASES:
            up, down = _powers(int(b), size)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
            out.append((total[ends] - total[starts]) * down[starts])
    return out[0], out[1]


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (h + np.uint64((0x632BE59BD9B4E019 * (level + 1)) & (2**64 - 1))) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys: per level a bitmap of slots hit by one key only; the rank is the index."""

    def __init__(self, keys: np.ndarray, load: float = 1.5):
        self.bits: list[np.ndarray] = []
        self.rank: list[np.ndarray] = []
        left, placed = keys, 0
        while len(left):
            size = max(64, int(len(left) * load))
            at = (_mix(left, len(self.bits)) % np.uint64(size)).astype(np.int64)
            single = np.bincount(at, minlength=size) == 1
            self.bits.append(single)
            self.rank.append(placed + np.cumsum(single) - 1)
            placed += int(single.sum())
            left = left[~single[at]]
        self.n = placed

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; -1, or another key's index, for a key outside the set."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, rank) in enumerate(zip(self.bits, self.rank)):
            at = (_mix(keys[todo], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[todo[hit]] = rank[at[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
        return out


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the lowest-ranked neighbouring pair is merged first, the leftmost among equals."""
    parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
    heap = [(r, i, parts[i] + parts[i + 1]) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, joined = heapq.heappop(heap)
        j = right[i]
        if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != joined:
            continue
        parts[i], parts[j] = joined, None
        right[i] = k = right[j]
        if k < len(parts):
            left[k] = i
            if (r := ranks.get(joined + parts[k])) is not None:
                heapq.heappush(heap, (r, i, joined + parts[k]))
        if (h := left[i]) >= 0 and (r := ranks.get(parts[h] + joined)) is not None:
            heapq.heappush(heap, (r, h, parts[h] + joined))
    return [ranks[p] for p in parts if p is not None]


class Encoder:
    """A byte-level BPE vocabulary given as ranks (`base64 rank` lines)."""

    def __init__(self, path: str = BYTE_BPE_50K):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        whole, ids = [], []
        for token, rank in self.ranks.items():
            try:
                whole.append(token.decode())
                ids.append(rank)
            except UnicodeDecodeError:
                continue
        points = np.frombuffer("".join(whole).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(w) for w in whole])
        h1, h2 = fingerprints(points, np.concatenate([[0], ends[:-1]]), ends)
        self.hash = PerfectHash(h1)
        slot = self.hash(h1)
        self.h1, self.h2, self.ids = np.empty_like(h1), np.empty_like(h2), np.empty(len(ids), np.int32)
        self.h1[slot], self.h2[slot], self.ids[slot] = h1, h2, np.asarray(ids, np.int32)
        self.memo: dict[str, list[int]] = {}

    def _miss(self, word: str) -> list[int]:
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            found = merge_bytes(word.encode(), self.ranks)
            if len(word) <= 64:
                self.memo[word] = found
        return found

    def pretokens(self, points: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of pre-tokens; no pre-token reaches over one of the sorted text starts `begins`.

        Runs of letters, of numbers and of other signs take one space before them; of white space before something else the
        last sign is left over; an apostrophe that begins a run takes a contraction with it.
        """
        n = len(points)
        kind = classes()[points]
        first = np.zeros(n + 1, bool)
        first[begins] = True
        first[n] = True
        edge = np.empty(n, bool)
        edge[0] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:])
        edge |= first[:n]
        space = kind == SPACE
        # The last white space of a run before another run of the same text starts a token of its own, and if it is a plain space it takes that run in.
        last = space.copy()
        last[:-1] &= ~space[1:] & ~first[1:n]
        last[-1] = False
        plain = last & (points == 32)
        edge |= last
        edge[1:] &= ~plain[:-1]
        for i in np.flatnonzero((points == 39) & edge).tolist():  # an apostrophe at the start of a pre-token
            if i + 1 >= n or first[i + 1] or kind[i + 1] != LETTER:
                continue
            two = chr(points[i + 1]) + (chr(points[i + 2]) if i + 2 < n and not first[i + 2] else "")
            take = next((len(c) for c in CONTRACTIONS if two.startswith(c)), 0)
            if take:
                edge[i + 1] = False
                j = i + 1 + take
                if j < n and kind[j] == LETTER and not first[j]:
                    edge[j] = True
        starts = np.flatnonzero(edge)
        return starts, np.append(starts[1:], n)

    def encode(self, texts: list[str], counts_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text); the first is empty if only counts are asked for."""
        ids, sizes = [], []
        at = 0
        while at < len(texts):
            total, stop = 0, at
            while stop < len(texts) and (stop == at or total + len(texts[stop]) <= CHUNK):
                total += len(texts[stop])
                stop += 1
            a, b = self._encode(texts[at:stop], counts_only)
            ids.append(a)
            sizes.append(b)
            at = stop
        return (np.concatenate(ids) if ids else np.empty(0, np.int32)), (np.concatenate(sizes) if sizes else np.empty(0, np.int64))

    def _encode(self, texts: list[str], counts_only: bool) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "".join(texts)
        if not joined:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        text_ends = np.cumsum(lengths)
        begins = np.unique((text_ends - lengths)[lengths > 0])
        starts, ends = self.pretokens(points, begins)
        h1, h2 = fingerprints(points, starts, ends)
        slot = self.hash(h1)
        hit = (slot >= 0) & (self.h1[slot] == h1) & (self.h2[slot] == h2)
        miss = np.flatnonzero(~hit)
        n_ids = np.ones(len(starts), np.int64)
        seen: dict[str, int] = {}  # the misses of these texts, each worked out once
        which = np.fromiter((seen.setdefault(joined[a:b], len(seen)) for a, b in zip(starts[miss].tolist(), ends[miss].tolist())), np.int64, len(miss))
        found = [self._miss(word) for word in seen]
        size = np.fromiter(map(len, found), np.int64, len(found))
        n_ids[miss] = size[which]
        offset = np.concatenate([[0], np.cumsum(n_ids)])
        per_text = np.diff(offset[np.searchsorted(starts, np.concatenate([[0], text_ends]))])
        if counts_only:
            return np.empty(0, np.int32), per_text
        out = np.empty(offset[-1], np.int32)
        out[offset[:-1][hit]] = self.ids[slot[hit]]
        if len(miss):
            flat = np.fromiter(chain.from_iterable(found), np.int32, int(size.sum()))
            own, at = size[which], (np.cumsum(size) - size)[which]
            step = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
            out[np.repeat(offset[:-1][miss], own) + step] = flat[np.repeat(at, own) + step]
        return out, per_text


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and path."""
    return Encoder(path)


def _ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = encoder(path).encode([t or "" for t in batch.column(1).to_pylist()])
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=["doc_id", "ids"])

    return run


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, sizes = encoder(path).encode([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()], counts_only=True)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes)], names=[*batch.schema.names[:-1], "n_tokens"])

    return run


def encode(documents: DataFrame, path: str = BYTE_BPE_50K) -> DataFrame:
    """doc_id, ids: the ids of each text without special tokens; strings like those of special tokens are ordinary text.

    A NULL or empty text has the empty list. Rows keep their number: a repeated doc_id comes out as often as it came in.
    """
    return documents.select("doc_id", "text").mapInArrow(_ids(path), "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, keep: list[str], path: str = BYTE_BPE_50K) -> DataFrame:
    """The columns of `keep` and n_tokens, the length of `encode`'s list (0 for NULL and empty texts)."""
    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    return documents.select(*keep, "text").mapInArrow(_counts(path), f"{kinds}, n_tokens bigint")
