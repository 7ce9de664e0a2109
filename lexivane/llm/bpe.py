"""Byte-level BPE with numpy: every row of a padded matrix merges its leftmost minimum-rank pair each round."""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import re
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: White space as the pattern's engine has it (Unicode's White_Space).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the pattern for which a text may be cut at white space first.
CUT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces longer than this are merged one by one with a heap, as rounds over a matrix would cost the square.
LONG = 256
#: Characters of distinct chunks that a task remembers before it starts afresh.
REMEMBERED = 16 << 20
#: Most bytes of a rank file, which is broadcast.
MOST_FILE = 64 << 20
NONE = np.iinfo(np.int32).max


class PairTable:
    """Open-addressing hash table from a pair of ids to the id of their concatenation."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        size = 1 << max(4, int(len(left) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - size.bit_length() + 1), np.uint64(size - 1)
        self.keys, self.values = np.full(size, np.uint64(2**64 - 1)), np.full(size, NONE, dtype=np.int32)
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot, todo = self._slots(keys), np.arange(len(keys))
        while len(todo):  # of the keys that want a free slot, the last written stays; the others move on
            free = self.keys[slot[todo]] == np.uint64(2**64 - 1)
            self.keys[slot[todo][free]] = keys[todo[free]]
            held = self.keys[slot[todo]] == keys[todo]
            self.values[slot[todo][held]] = merged[todo[held]]
            todo = todo[~held]
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged id of each pair, NONE where there is none. Ids below 0 pad."""
        out = np.full(left.shape, NONE, dtype=np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        keys = (left.ravel()[at].astype(np.uint64) << np.uint64(32)) | right.ravel()[at].astype(np.uint64)
        slot, flat = self._slots(keys), out.ravel()
        while len(at):
            there = self.keys[slot]
            hit = there == keys
            flat[at[hit]] = self.values[slot[hit]]
            on = ~hit & (there != np.uint64(2**64 - 1))
            at, keys, slot = at[on], keys[on], (slot[on] + np.uint64(1)) & self.mask
        return flat.reshape(out.shape)


class Vocabulary:
    """Ranks of byte strings, read from a file of base64 token and rank per line."""

    def __init__(self, lines: Iterable[bytes], pattern: str) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.bytes = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int32)
        if (self.bytes < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        pairs = [(a, b, rank) for token, rank in self.ranks.items() for k in range(1, len(token)) if (a := self.ranks.get(token[:k])) is not None and (b := self.ranks.get(token[k:])) is not None]
        self.pairs = PairTable(*(np.array(x, dtype=np.int32) for x in zip(*pairs))) if pairs else PairTable(*[np.empty(0, dtype=np.int32)] * 3)
        self.fine = regex.compile(pattern)
        # Matches of CUT_PATTERN never run from a character other than white space into white space, so a text can be
        # cut there first; what a chunk splits into does not depend on its neighbours. Of no other pattern is that known.
        cut = pattern == CUT_PATTERN
        self.chunks = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall if cut else self._matches
        self.pieces = self.fine.findall if cut else lambda chunk: [chunk]
        self.known: dict[str, tuple[int, ...]] = {}
        self.held = 0

    def _matches(self, text: str) -> list[str]:
        return [m[0] for m in self.fine.finditer(text) if m[0]]

    def encode_pieces(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each piece; pieces of like length share a matrix."""
        out: list[tuple[int, ...]] = [()] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            if (rank := self.ranks.get(piece)) is not None:
                out[k] = (rank,)
            elif len(piece) > LONG:
                out[k] = self._encode_long(piece)
            else:
                buckets.setdefault(-(-len(piece) // 4), []).append(k)
        for width, rows in buckets.items():
            step = max(1, (1 << 18) // (4 * width))
            for lo in range(0, len(rows), step):
                part = rows[lo : lo + step]
                for k, ids in zip(part, self._merge([pieces[k] for k in part], 4 * width)):
                    out[k] = ids
        return out

    def _merge(self, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(-1, width)
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        ids = np.where(np.arange(width) < size[:, None], self.bytes[raw], -1)
        merged = self.pairs.find(ids[:, :-1], ids[:, 1:])
        live = np.arange(len(pieces))
        out: list[tuple[int, ...]] = [()] * len(pieces)
        while len(live):
            at = merged.argmin(axis=1)  # the first minimum: the leftmost pair of least rank
            rank = merged[np.arange(len(live)), at]
            done = rank == NONE
            if done.any():
                for k, row, n in zip(live[done], ids[done].tolist(), size[done]):
                    out[k] = tuple(row[:n])
                keep = ~done
                live, ids, merged, size, at, rank = live[keep], ids[keep], merged[keep], size[keep], at[keep], rank[keep]
                if not len(live):
                    break
            # Compaction: what stands right of the merged pair moves one place to the left.
            r, width = np.arange(len(live)), ids.shape[1]
            source = np.arange(width - 1) + (np.arange(width - 1) > at[:, None])
            ids = np.take_along_axis(ids, source, axis=1)
            ids[r, at] = rank
            size = size - 1
            if ids.shape[1] > (most := int(size.max())) and most >= 1:
                ids = ids[:, :most]
            if ids.shape[1] < 2:
                for k, row in zip(live, ids.tolist()):
                    out[k] = tuple(row[:1])
                break
            # Only the pairs that touch the new id change.
            merged = np.take_along_axis(merged, np.minimum(np.arange(ids.shape[1] - 1) + (np.arange(ids.shape[1] - 1) >= at[:, None]), merged.shape[1] - 1), axis=1)
            for where in (at - 1, at):
                ok = (where >= 0) & (where < ids.shape[1] - 1)
                q, c = r[ok], where[ok]
                merged[q, c] = self.pairs.find(ids[q, c], ids[q, c + 1])
        return out

    def _encode_long(self, piece: bytes) -> tuple[int, ...]:
        ids: list[int] = self.bytes[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n = len(ids)
        before, after, tokens = list(range(-1, n - 1)), list(range(1, n + 1)), [self.tokens[i] for i in ids]
        heap = [(r, k, 1, 1) for k in range(n - 1) if (r := self.ranks.get(tokens[k] + tokens[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            j = after[k] if ids[k] >= 0 else n
            if j >= n or len(tokens[k]) != a or len(tokens[j]) != b or ids[j] < 0:
                continue
            ids[k], tokens[k], ids[j] = r, tokens[k] + tokens[j], -1
            after[k] = after[j]
            if after[j] < n:
                before[after[j]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y < n and (r := self.ranks.get(tokens[x] + tokens[y])) is not None:
                    heapq.heappush(heap, (r, x, len(tokens[x]), len(tokens[y])))
        return tuple(i for i in ids if i >= 0)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of every whole text; None gives none."""
        cut = [self.chunks(t) if t else [] for t in texts]
        known = self.known
        seen = set(chain.from_iterable(cut))
        new = seen.difference(known)
        size = sum(map(len, new))
        if self.held + size > REMEMBERED and known:
            known.clear()
            new, self.held, size = seen, 0, sum(map(len, seen))
        self.held += size
        gc.disable()  # nothing here refers to itself, and each collection would go through all that is known
        try:
            self._learn(list(new))
        finally:
            gc.enable()
        return [list(chain.from_iterable(map(known.__getitem__, chunk))) for chunk in cut]

    def _learn(self, chunks: list[str]) -> None:
        split = list(map(self.pieces, chunks))
        pieces = list(set(chain.from_iterable(split)))
        ids = dict(zip(pieces, self.encode_pieces(list(map(str.encode, pieces)))))
        for c, s in zip(chunks, split):
            self.known[c] = ids[s[0]] if len(s) == 1 else tuple(chain.from_iterable(map(ids.__getitem__, s)))

    def decode(self, ids: list[int] | None) -> bytes:
        """Bytes of a list of ids, whether or not they form whole characters."""
        return b"".join(map(self.tokens.__getitem__, ids or ()))


_loaded: dict[tuple[str, str], Vocabulary] = {}


def encode(df: DataFrame, ranks_path: str, pattern: str = CUT_PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids, decoded): the ids of every whole text, and the bytes that these ids decode to.

    `ranks_path` is a rank file on the driver, of MOST_FILE bytes at most; its contents are broadcast. `pattern` may be
    any; the one usual pattern is worked on faster. Null and empty texts have no ids. Rows with a null id, repeated
    rows and ties keep their rows; an empty table gives an empty result; columns other than the two named are left
    out, whatever their names. A text is encoded whole, in memory of some 60 times its size; a piece of over LONG bytes
    is merged in its own heap, in time of n log n instead of the square.
    """
    with open(ranks_path, "rb") as f:
        data = f.read(MOST_FILE + 1)
    if len(data) > MOST_FILE:
        raise ValueError(f"{ranks_path} has more than {MOST_FILE} bytes")
    key, shared = (hashlib.sha256(data).hexdigest(), pattern), df.sparkSession.sparkContext.broadcast(data)

    def make():
        if key not in _loaded:  # once a worker
            _loaded[key] = Vocabulary(shared.value.splitlines(), pattern)
        own = _loaded[key]

        def work(rows: list[tuple]) -> Iterable[tuple]:
            ids = own.encode([t for _, t in rows])
            return [(i, x, own.decode(x)) for (i, _), x in zip(rows, ids)]

        return work

    schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])
    return map_rows(df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), make, schema, "id long, ids array<int>, decoded binary", chunk_bytes=1 << 20, size_of=1)
