"""Substring dedup over word windows by super-k-mer partitioning."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpoint, map_rows, to_batches

WINDOW = 13
#: Words of a minimiser. Sequences of five words are rare but where texts repeat, so buckets hold what repeats.
MINIMISER = 5
#: Bytes of whole texts that are worked on together; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Bytes of text, on average, whose windows go to one bin of buckets.
BIN_BYTES = 2 << 20
#: Strings of one bucket beyond which its windows are dealt out one by one, by their own hash.
HOT_STRINGS = 5_000
#: Bytes of strings that a bin holds before what has come is counted.
HELD_BYTES = 16 << 20
#: Bytes that are hashed at once.
_BLOCK = 1 << 19
_GAP = np.zeros(256, dtype=bool)
_GAP[list(b" \t\n\v\f\r")] = True
_BYTES = np.random.default_rng(7).integers(0, 1 << 64, size=256, dtype=np.uint64)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2 ** 64, as many as were asked for."""

    def __init__(self, base: int) -> None:
        self.bases = base, pow(base, -1, 1 << 64)
        self.held = [np.ones(1, dtype=np.uint64)] * 2

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.held[0]) < n:
            self.held = [np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(n, b, dtype=np.uint64))), dtype=np.uint64) for b in self.bases]
        return self.held[0][:n], self.held[1][:n]


_of_bytes, _of_words = _Powers(0x9E3779B97F4A7C15), _Powers(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


def _slices(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, powers: _Powers) -> np.ndarray:
    """Hash of each slice lo:hi of the values, from running sums: equal slices are equal wherever they stand."""
    up, down = powers(len(values) + 1)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(values * up[:-1], dtype=np.uint64)))
    return _mix((sums[hi] - sums[lo]) * down[lo])


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All words of the texts joined by one space, as bytes, and the number of words of each text."""
    flat = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    gap = _GAP[flat]
    before = np.concatenate(([True], gap[:-1]))
    ends = np.cumsum([len(t) + 1 for t in texts])
    firsts = np.flatnonzero(~gap & before)
    counts = np.diff(np.searchsorted(firsts, ends), prepend=0)
    kept = ~(gap & before)
    packed = np.where(gap, np.uint8(32), flat)[kept]
    return packed[:-1] if len(packed) else packed, counts


class Words:
    """The words of texts joined by one space: where each begins and ends, and its hash."""

    def __init__(self, packed: np.ndarray) -> None:
        self.packed = packed
        spaces = np.flatnonzero(packed == 32)
        self.begin = np.concatenate(([0], spaces + 1)) if len(packed) else np.zeros(0, dtype=np.int64)
        self.end = np.append(spaces, len(packed)) if len(packed) else self.begin
        cuts = np.unique(np.append(np.searchsorted(self.begin, np.arange(0, len(packed), _BLOCK)), len(self.begin)))
        parts = [np.zeros(0, dtype=np.uint64)]
        for a, b in zip(cuts, cuts[1:]):  # whole words, in blocks of bounded size
            lo = self.begin[a]
            parts.append(_slices(_BYTES[packed[lo : self.end[b - 1]]], self.begin[a:b] - lo, self.end[a:b] - lo, _of_bytes))
        self.hash = np.concatenate(parts)

    def __len__(self) -> int:
        return len(self.begin)

    def sequences(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on."""
        at = np.arange(max(0, len(self) - n + 1))
        return _slices(self.hash, at, at + n, _of_words)

    def bytes(self, first: int, end: int) -> bytes:
        return self.packed[self.begin[first] : self.end[end - 1]].tobytes()


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[: len(values) - step], values[step:])
        have += step
    return values


def super_kmers(words: Words, owner: np.ndarray, window: int = WINDOW, m: int = MINIMISER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, end) of each longest run of windows of one owner with one minimiser.

    The minimiser is the least hash of m words in a window; `owner` is each word's text, negative for none.
    """
    if len(words) < window:
        return (np.zeros(0, dtype=np.uint64), *(np.zeros(0, dtype=np.int64),) * 2)
    least = _least(words.sequences(m), window - m + 1)
    own = owner[: len(least)]
    inside = (own == owner[window - 1 :]) & (own >= 0)
    new = np.concatenate(([True], (least[1:] != least[:-1]) | (own[1:] != own[:-1]) | (inside[1:] != inside[:-1])))
    first = np.flatnonzero(new)
    end = np.append(first[1:], len(least))
    runs = inside[first]
    return least[first[runs]], first[runs], end[runs]


def held_before(words: Words, at: np.ndarray, docs: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each window (its first word in `at`, its document in `docs`), whether an equal one has a smaller document.

    Windows are sorted by their hash, then document; neighbours with one hash are then compared by their words,
    whole stretches of text at once.
    """
    gone = np.zeros(len(at), dtype=bool)
    h = words.sequences(window)[at]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    twin = np.concatenate((same, [False])) | np.concatenate(([False], same))
    some = order[twin]
    some = some[np.lexsort((at[some], docs[some], h[some]))]
    if not len(some):
        return gone
    new = np.concatenate(([True], h[some[1:]] != h[some[:-1]]))
    group = np.cumsum(new) - 1
    least = docs[some[new]][group]
    cur, prev = at[some[1:]][~new[1:]], at[some[:-1]][~new[1:]]
    by = np.argsort(cur, kind="stable")
    cur, prev = cur[by], prev[by]
    cut = np.flatnonzero((cur[1:] != cur[:-1] + 1) | (prev[1:] != prev[:-1] + 1)) + 1
    for a, b in zip(np.concatenate(([0], cut)).tolist(), np.append(cut, len(cur)).tolist()):
        n = b - a + window - 1
        if words.bytes(cur[a], cur[a] + n) != words.bytes(prev[a], prev[a] + n):  # some hash stands for several sequences
            for g in np.unique(group[np.isin(at[some], cur[a:b])]):
                first: dict[bytes, int] = {}
                for k in np.flatnonzero(group == g):
                    least[k] = first.setdefault(words.bytes(at[some[k]], at[some[k]] + window), docs[some[k]])
    gone[some] = docs[some] > least
    return gone


def _runs(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end in the two arrays of each run of one key whose positions follow each other."""
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)))[: len(at)]
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(at)) if len(at) else first


def _ranges(at: np.ndarray, window: int) -> bytes:
    """The words that windows from the positions cover, as pairs of first word and end."""
    at = np.unique(at)
    new = np.concatenate(([True], at[1:] > at[:-1] + window))
    last = np.append(np.flatnonzero(new)[1:], len(at)) - 1
    return np.stack((at[new], at[last] + window), axis=1).astype("<i4").tobytes()


def _chunks(df: DataFrame) -> DataFrame:
    """Rows (chunk, ids, counts, size, packed): the words of whole texts (doc, text), about CHUNK_BYTES together."""
    bounded_batches(df.sparkSession)
    fields = [("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("counts", pa.binary()), ("size", pa.int64()), ("packed", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pack, made = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=3), 0
        ids: list = []
        texts: list[bytes] = []
        held = 0

        def chunk() -> pa.RecordBatch:
            packed, counts = joined(texts)
            row = ((part << 32) + made, ids, counts.astype("<i4").tobytes(), len(packed), pack.compress(packed.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([x], type=t) for x, (_, t) in zip(row, fields)], names=[n for n, _ in fields])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = text.as_py() or b""
                if texts and held + len(data) > CHUNK_BYTES:
                    yield chunk()
                    ids, texts, held, made = [], [], 0, made + 1
                ids.append(i)
                texts.append(data)
                held += len(data)
        if texts:
            yield chunk()

    return df.mapInArrow(run, "chunk long, ids array<long>, counts binary, size long, packed binary")


PACKED = ("chunk", "ids", "counts", "packed")


class _Chunk:
    """A chunk opened again: its words, and the super-k-mers of its texts in the order of their bins."""

    def __init__(self, ids: list, counts: bytes, packed: bytes, bins: int, window: int, m: int) -> None:
        n = np.frombuffer(counts, dtype="<i4")
        self.words = Words(np.frombuffer(zstandard.decompress(packed), dtype=np.uint8))
        known = np.array([i is not None for i in ids], dtype=bool)
        self.docs = np.repeat(np.array([i or 0 for i in ids], dtype=np.int64), n)
        least, self.first, self.end = super_kmers(self.words, np.repeat(np.where(known, np.arange(len(ids)), -1), n), window, m)
        order = np.lexsort((least, least % np.uint64(bins)))
        least, self.first, self.end = least[order], self.first[order], self.end[order]
        #: Each distinct bucket's first super-k-mer, bucket and bin; and the bucket's number for each super-k-mer.
        new = np.concatenate(([True], least[1:] != least[:-1]))[: len(least)]
        self.at = np.flatnonzero(new)
        self.bucket = least[self.at]
        self.bin = (self.bucket % np.uint64(bins)).astype(np.int64)
        self.number = np.cumsum(new) - 1

    def of_bins(self) -> Iterator[tuple[int, int, int]]:
        """(bin, start, end) of the runs of distinct buckets."""
        cut = np.flatnonzero(np.diff(self.bin)) + 1
        for a, b in zip(np.concatenate(([0], cut)).tolist(), np.append(cut, len(self.bin)).tolist()):
            if b > a:
                yield int(self.bin[a]), a, b


def _buckets(chunks: DataFrame, bins: int, window: int, m: int) -> DataFrame:
    """Rows (bin, chunk, entries): the chunk's buckets in the bin, with their number of strings in the lowest byte."""

    def work(rows: list[tuple]) -> Iterable[tuple]:
        for chunk, ids, counts, packed in rows:
            own = _Chunk(ids, counts, packed, bins, window, m)
            n = np.diff(np.append(own.at, len(own.first)))
            entries = (own.bucket & ~np.uint64(255)) | np.minimum(n, 255).astype(np.uint64)
            for b, lo, hi in own.of_bins():
                yield b, chunk, entries[lo:hi].tobytes()

    schema = pa.schema([("bin", pa.int64()), ("chunk", pa.int64()), ("entries", pa.binary())])
    return map_rows(chunks.select("chunk", "ids", "counts", "packed"), lambda: work, schema, "bin long, chunk long, entries binary", chunk_bytes=1, size_of=3)


def _by_bin(df: DataFrame, work: Callable[[Iterator[tuple]], Iterable[tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
    """`work` over all rows of a task, whose bins (the first column) come whole and in runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        yield from to_batches(work(rows), schema, 100)

    return df.repartition("bin").sortWithinPartitions("bin").mapInArrow(run, ddl)


def _shared(most: int) -> Callable[[Iterator[tuple]], Iterator[tuple]]:
    """(chunk, bin, shared, hot): bits over a chunk's buckets in the bin, set where another chunk has it, and where over `most` strings are in it."""

    def work(all_rows: Iterator[tuple]) -> Iterator[tuple]:
        for _, rows in groupby(all_rows, key=lambda r: r[0]):
            yield from one(list(rows))

    def one(rows: list[tuple]) -> Iterator[tuple]:
        entries = [np.frombuffer(e, dtype="<u8") for _, _, e in rows]
        flat = np.concatenate(entries)
        bucket, n = flat >> np.uint64(8), (flat & np.uint64(255)).astype(np.int64)
        order = np.argsort(bucket)
        first = np.flatnonzero(np.concatenate(([True], bucket[order[1:]] != bucket[order[:-1]])))
        size = np.diff(np.append(first, len(order)))
        shared, hot = np.zeros(len(flat), dtype=bool), np.zeros(len(flat), dtype=bool)
        shared[order] = np.repeat(size > 1, size)
        hot[order] = np.repeat((size > 1) & (np.add.reduceat(n[order], first) > most), size)
        lo = 0
        for (b, chunk, _), e in zip(rows, entries):
            yield chunk, b, np.packbits(shared[lo : lo + len(e)]).tobytes(), np.packbits(hot[lo : lo + len(e)]).tobytes()
            lo += len(e)

    return work


_STRINGS = "bin long, chunk long, docs binary, at binary, size binary, packed binary"


def _strings(chunks: DataFrame, bins: int, window: int, m: int) -> DataFrame:
    """Rows (bin, chunk, docs, at, size, packed) of the strings of shared buckets, from chunks with what is known of their buckets.

    The windows of a chunk are counted first, among themselves; what goes by that has a row with a negative bin,
    whose `at` are ranges, and does not travel.
    """

    def work(rows: list[tuple]) -> Iterable[tuple]:
        pack = zstandard.ZstdCompressor(level=1)
        for chunk, ids, counts, packed, told in rows:
            own = _Chunk(ids, counts, packed, bins, window, m)
            told = {t["bin"]: t for t in told}
            bits = {"shared": np.zeros(len(own.bin), dtype=bool), "hot": np.zeros(len(own.bin), dtype=bool)}
            for b, lo, hi in own.of_bins():
                for k, v in bits.items():
                    v[lo:hi] = np.unpackbits(np.frombuffer(told[b][k], dtype=np.uint8), count=hi - lo)
            n = np.diff(np.append(own.at, len(own.first)))
            shared, near = bits["shared"][own.number], (bits["shared"] | (n > 1))[own.number]
            which = np.repeat(np.arange(len(own.first))[near], (own.end - own.first)[near])
            at = _counted(own.first[near], own.end[near])
            gone = held_before(own.words, at, own.docs[at], window) if len(at) else np.zeros(0, dtype=bool)
            if gone.any():
                yield -1 - chunk, chunk, None, _ranges(at[gone], window), None, None
            left = ~gone & shared[which]
            which, at = which[left], at[left]
            hot = bits["hot"][own.number[which]]
            first, end = _runs(which[~hot], at[~hot])
            lo, n_windows = at[~hot][first], end - first
            to = own.bin[own.number[which[~hot][first]]]
            if hot.any():  # each window by itself
                lo, n_windows = np.append(lo, at[hot]), np.append(n_windows, np.ones(hot.sum(), dtype=np.int64))
                to = np.append(to, (own.words.sequences(window)[at[hot]] % np.uint64(bins)).astype(np.int64))
                order = np.argsort(to, kind="stable")
                lo, n_windows, to = lo[order], n_windows[order], to[order]
            size = n_windows + window - 1
            cut = np.flatnonzero(np.diff(to)) + 1
            begin, stop, data = own.words.begin[lo].tolist(), own.words.end[lo + size - 1].tolist(), own.words.packed.tobytes()
            for a, b in zip(np.concatenate(([0], cut)).tolist(), np.append(cut, len(to)).tolist()):
                if b > a:
                    flat = b" ".join([data[x:y] for x, y in zip(begin[a:b], stop[a:b])])
                    yield int(to[a]), chunk, own.docs[lo[a:b]].tobytes(), lo[a:b].astype("<i4").tobytes(), size[a:b].astype("<i4").tobytes(), pack.compress(flat)

    kinds = {"long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in _STRINGS.split(", "))])
    return map_rows(chunks.select("chunk", "ids", "counts", "packed", "told"), lambda: work, schema, _STRINGS, chunk_bytes=1, size_of=3)


def _counted(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers from each first to its end, one after the other."""
    n = end - first
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def _parts(sorted_keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, start, end) of the runs of equal keys."""
    cut = np.flatnonzero(np.diff(sorted_keys)) + 1
    for a, b in zip(np.concatenate(([0], cut)).tolist(), np.append(cut, len(sorted_keys)).tolist()):
        if b > a:
            yield int(sorted_keys[a]), a, b


class _Bin:
    """A bin's strings, counted whenever HELD_BYTES more have come, so that only distinct windows are kept."""

    def __init__(self, window: int) -> None:
        self.window, self.rows, self.held, self.most = window, [], 0, HELD_BYTES

    def add(self, row: tuple) -> Iterator[tuple]:
        """Takes a row of _STRINGS; yields (chunk, ranges) of what goes by then."""
        self.rows.append((*row[:5], zstandard.decompress(row[5])))
        self.held += len(self.rows[-1][5])
        if self.held > self.most:
            yield from self.count(keep=True)
            self.most = max(HELD_BYTES, 2 * self.held)

    def count(self, keep: bool = False) -> Iterator[tuple]:
        """(chunk, ranges) of the words that windows cover which a smaller document holds, too. With `keep`, the others stay."""
        rows, window = self.rows, self.window
        words = Words(np.frombuffer(b" ".join([r[5] for r in rows]), dtype=np.uint8))
        docs, at, size = (np.concatenate([np.frombuffer(r[k], dtype=t) for r in rows]) for k, t in ((2, "<i8"), (3, "<i4"), (4, "<i4")))
        row = np.repeat(np.arange(len(rows)), [len(r[4]) // 4 for r in rows])
        first = np.cumsum(size, dtype=np.int64) - size
        windows = size - window + 1
        here, string = _counted(first, first + windows), np.repeat(np.arange(len(size)), windows)
        gone = held_before(words, here, docs[string], window)
        there = at[string] + here - first[string]
        which = row[string]
        lost = there[gone]
        for r, lo, hi in _parts(which[gone]):  # in the order of the rows already
            yield rows[r][1], _ranges(lost[lo:hi], window)
        self.rows, self.held = [], 0
        if keep:
            here, string, there, which = here[~gone], string[~gone], there[~gone], which[~gone]
            for r, a, b in _parts(which):
                lo, hi = _runs(string[a:b], here[a:b])
                begin, n = here[a:b][lo], hi - lo + window - 1
                flat = b" ".join([words.bytes(x, x + k) for x, k in zip(begin.tolist(), n.tolist())])
                self.rows.append((*rows[r][:2], docs[string[a:b][lo]].tobytes(), there[a:b][lo].astype("<i4").tobytes(), n.astype("<i4").tobytes(), flat))
                self.held += len(flat)


def _count(window: int) -> Callable[[Iterator[tuple]], Iterator[tuple]]:
    """(chunk, ranges) of the words to remove, from rows of _STRINGS whose bins come in runs. Rows that are ranges already go through."""

    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, held = None, _Bin(window)
        for row in rows:
            if row[0] < 0:
                yield row[1], row[3]
                continue
            if row[0] != now and held.rows:
                yield from held.count()
                held = _Bin(window)
            now = row[0]
            yield from held.add(row)
        if held.rows:
            yield from held.count()

    return work


def repeated_ranges(chunks: DataFrame, window: int = WINDOW, m: int = MINIMISER) -> DataFrame:
    """Rows (chunk, ranges): word ranges of each chunk that repeat a smaller document, as arrays of first word and end.

    First only buckets meet, without strings: a bucket that one chunk alone has is counted there. The strings of
    the others then travel to their bucket's bin and are counted.
    """
    total = chunks.agg(F.sum("size")).first()[0] or 0
    bins = max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BIN_BYTES))
    told = _by_bin(_buckets(chunks, bins, window, m), _shared(HOT_STRINGS), pa.schema([("chunk", pa.int64()), ("bin", pa.int64()), ("shared", pa.binary()), ("hot", pa.binary())]), "chunk long, bin long, shared binary, hot binary")
    told = told.groupBy("chunk").agg(F.collect_list(F.struct("bin", "shared", "hot")).alias("told"))
    strings = _strings(chunks.select(*PACKED).join(told, "chunk"), bins, window, m)
    found = _by_bin(strings, _count(window), pa.schema([("chunk", pa.int64()), ("ranges", pa.binary())]), "chunk long, ranges binary")
    return found.groupBy("chunk").agg(F.collect_list("ranges").alias("ranges"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, m: int = MINIMISER) -> DataFrame:
    """Rows (id, text, n_words, n_removed): texts without the words in windows that a smaller document also has.

    Windows are judged on the input. Kept words are joined by one space. Null texts count as empty; texts shorter
    than a window lose nothing; rows with a null id keep their words and don't count as smaller than others; rows
    that share an id are one document, so they never remove each other's words; an empty table gives an empty
    result; columns other than the two named are left out, whatever their names. A text is worked on whole, in
    memory of about 20 times its size.

    A bucket holds the windows around one sequence of `m` words. Windows that recur in a chunk of texts are
    counted there and travel once, a bucket of more than HOT_STRINGS strings is dealt out window by window, and a
    bin counts what has come before it takes more, so neither a common sequence nor a passage of many documents
    gathers in one place: a task holds distinct windows, and eight bytes for each chunk that shares a bucket.
    """
    if not 0 < m <= window:
        raise ValueError("a minimiser is a part of a window")
    chunks = checkpoint(_chunks(df.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary"))))
    # Both joins shuffle the same columns of the same rows, so the second reads the first one's shuffle again.
    chunks = chunks.where(F.col("chunk").isNotNull())
    both = chunks.select(*PACKED).join(repeated_ranges(chunks, window, m), "chunk", "left").select(*PACKED[1:], "ranges")

    def work(rows: list[tuple]) -> Iterable[tuple]:
        for ids, counts, packed, ranges in rows:
            n, words = np.frombuffer(counts, dtype="<i4"), zstandard.decompress(packed)
            spaces = np.flatnonzero(np.frombuffer(words, dtype=np.uint8) == 32)
            begin, end = np.concatenate(([0], spaces + 1)), np.append(spaces, len(words))
            edge = np.zeros(n.sum() + 1, dtype=np.int32)
            for r in ranges or ():
                lo, hi = np.frombuffer(r, dtype="<i4").reshape(-1, 2).T
                np.add.at(edge, lo, 1)
                np.add.at(edge, hi, -1)
            gone = np.cumsum(edge[:-1]) > 0
            at = 0
            for i, size in zip(ids, n.tolist()):
                mask = gone[at : at + size]
                lost = int(np.count_nonzero(mask))
                if not lost:
                    text = words[begin[at] : end[at + size - 1]] if size else b""
                else:
                    turn = np.flatnonzero(np.diff(np.concatenate(([True], mask, [True])))).reshape(-1, 2)
                    text = b" ".join([words[begin[at + a] : end[at + b - 1]] for a, b in turn.tolist()])
                yield i, text.decode(), size, lost
                at += size

    schema = pa.schema([("id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())])
    return map_rows(both, lambda: work, schema, "id long, text string, n_words long, n_removed long", chunk_bytes=1, size_of=2)


#: SQL over `documents` with the same result as the query.
SQL = rf"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
k as (select doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) as i from w where len(w) >= {WINDOW})),
m as (select g, min(doc_id) as least from k group by g),
c as (select distinct doc_id, unnest(range(i, i + {WINDOW})) as j from k join m using (g) where least < doc_id),
x as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as j from w),
y as (select x.doc_id, x.word, x.j, c.j is not null as gone from x left join c on c.doc_id = x.doc_id and c.j = x.j),
s as (select doc_id, count(*) filter (where gone) as n_removed, string_agg(word, ' ' order by j) filter (where not gone) as kept from y group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join s using (doc_id)
"""
