"""Benchmark decontamination: a BM25 index of test items searched with block-max WAND, then overlap of question and answer."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpoint, chunks, fresh

K1, B = 1.2, 0.75
#: Share of an item's own BM25 score that a passage must reach to be verified.
RETRIEVE = 0.7
#: Share of the five-word shingles of an item, or of its question and of its answer, that a passage must hold.
OVERLAP = 0.8
SHINGLE = 5
#: Words of a passage; it grows with the longest item so that every item lies whole in some passage.
PASSAGE = 128
#: Items of a block of a posting list.
BLOCK = 4
#: Items, and bytes of items, of one broadcast index; more items are searched index by index.
MOST_ITEMS, MOST_BYTES = 20_000, 16 << 20
#: A share for items that are known to end in their answer; items without an answer column are verified whole.
ANSWER_SHARE = 1 / 3
_WORD = re.compile(r"\w+")

MATCHES = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double>>"


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(words: list, width: int = SHINGLE) -> set[tuple]:
    """Word shingles; a shorter list is one shingle, an empty one has none."""
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


class ItemIndex:
    """Posting lists by term of (item, impact), cut in blocks with their maxima.

    An impact is a term's BM25 weight in the item as a share of the item's own score, so one threshold holds
    for all items.
    """

    def __init__(self, items: list[tuple[int, str, str]], block: int = BLOCK) -> None:
        """items: (item_id, question, answer), in any order; those without a word are left out."""
        split = [(i, tokens(q), tokens(a)) for i, q, a in items]
        split = sorted((x for x in split if x[1] or x[2]), key=lambda x: x[0])
        self.ids = [i for i, _, _ in split]
        self.questions, self.answers = [shingles(q) for _, q, _ in split], [shingles(a) for _, _, a in split]
        held = [Counter(q + a) for _, q, a in split]
        mean = sum(sum(c.values()) for c in held) / max(1, len(held))
        df = Counter(t for c in held for t in c)
        self.terms = {t: k for k, t in enumerate(sorted(df))}
        self.block = block
        self.postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for n, c in enumerate(held):
            length = K1 * (1 - B + B * sum(c.values()) / mean)
            raw = {t: math.log(1 + (len(held) - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + length) for t, f in c.items()}
            own = sum(raw.values())
            for t, x in raw.items():
                self.postings[self.terms[t]].append((n, x / own))
        self.at = [[n for n, _ in p] for p in self.postings]
        self.most = np.array([max(x for _, x in p) for p in self.postings] + [0.0], dtype=np.float32)
        #: Largest impact of each term in each block that its posting list has; as large as the lists, whatever the items.
        self.bounds: list[dict[int, float]] = [{} for _ in self.terms]
        for t, p in enumerate(self.postings):
            for n, x in p:
                self.bounds[t][n // block] = max(self.bounds[t].get(n // block, 0.0), x)
        # The same term after term, to sum the maxima of many terms at once.
        self.sizes = np.array([len(b) for b in self.bounds], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blocks = np.array([n for b in self.bounds for n in b], dtype=np.int64)
        self.maxima = np.array([x for b in self.bounds for x in b.values()], dtype=np.float64)
        self.longest = max((sum(c.values()) for c in held), default=0)

    def _block_bound(self, terms: np.ndarray) -> float:
        """Largest sum over a block of the terms' maxima there."""
        n = self.sizes[terms]
        if not n.sum():
            return 0.0
        at = np.arange(n.sum()) + np.repeat(self.starts[terms] - np.cumsum(n) + n, n)
        return float(np.bincount(self.blocks[at], self.maxima[at]).max())

    def search(self, terms: list[int], least: float) -> Iterator[tuple[int, float]]:
        """All (item, score) with at least `least`, by block-max WAND over the distinct terms of a passage."""
        lists = [[0, t] for t in terms if self.at[t]]  # (position, term) cursors
        while lists:
            lists.sort(key=lambda c: self.at[c[1]][c[0]])
            bound, pivot = 0.0, None
            for k, (p, t) in enumerate(lists):
                bound += float(self.most[t])
                if bound >= least - 1e-6:
                    pivot = self.at[t][p]
                    break
            if pivot is None:
                return
            last = k
            while last + 1 < len(lists) and self.at[lists[last + 1][1]][lists[last + 1][0]] == pivot:
                last += 1
            block = pivot // self.block
            if sum(self.bounds[t].get(block, 0.0) for _, t in lists[: last + 1]) < least - 1e-6:
                # No item of this block up to the next cursor can reach the threshold: all cursors skip it.
                target = (block + 1) * self.block
                if last + 1 < len(lists):
                    target = min(target, self.at[lists[last + 1][1]][lists[last + 1][0]])
                target = max(target, pivot + 1)
            elif self.at[lists[0][1]][lists[0][0]] == pivot:
                score = sum(self.postings[t][p][1] for p, t in lists[: last + 1])
                if score >= least - 1e-6:
                    yield pivot, score
                target = pivot + 1
            else:
                target = pivot
            for c in lists[: last + 1]:
                if self.at[c[1]][c[0]] < target:
                    c[0] = bisect_left(self.at[c[1]], target, c[0])
            lists = [c for c in lists if c[0] < len(self.at[c[1]])]

    def find(self, texts: list[str | None], retrieve: float = RETRIEVE, overlap: float = OVERLAP) -> list[list[tuple]]:
        """Per text the items (id, best score, question and answer overlap) that one of its passages holds."""
        out: list[list[tuple]] = [[] for _ in texts]
        width = max(PASSAGE, 2 * self.longest)
        step = width // 2
        split = [tokens(t) for t in texts]
        none = len(self.terms)
        size = np.array([len(s) for s in split], dtype=np.int64)
        if not self.ids or not size.sum():
            return out
        get = self.terms.get
        ids = np.fromiter((get(w, none) for s in split for w in s), dtype=np.int32, count=int(size.sum()))
        count = np.maximum(1, -(-(size - step) // step)) * (size > 0)
        doc = np.repeat(np.arange(len(texts)), count)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        offset = (np.cumsum(size) - size)[doc]
        lo, hi = offset + nth * step, np.minimum(offset + nth * step + width, offset + size[doc])
        # Without a pivot: the passages whose terms' maxima together miss the threshold, repeats counted.
        reach = np.concatenate(([0.0], np.cumsum(self.most[ids], dtype=np.float64)))
        live = np.flatnonzero(reach[hi] - reach[lo] >= retrieve - 1e-6)
        for k in live:
            distinct = np.unique(ids[lo[k] : hi[k]])
            if distinct[-1] == none:
                distinct = distinct[:-1]
            if self.most[distinct].sum() < retrieve - 1e-6 or self._block_bound(distinct) < retrieve - 1e-6:
                continue
            base = lo[k] - offset[k]
            words = split[doc[k]][base : base + hi[k] - lo[k]]
            have = None
            for n, score in self.search(distinct.tolist(), retrieve):
                have = have or {w: _all_shingles(words, w) for w in range(1, SHINGLE + 1)}
                q, a = (_share(x, have) for x in (self.questions[n], self.answers[n]))
                if q >= overlap and a >= overlap:
                    out[doc[k]].append((self.ids[n], score, q, a))
        return [_best(x) for x in out]


def _all_shingles(words: list[str], width: int) -> set[tuple]:
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def _share(wanted: set[tuple], have: dict[int, set[tuple]]) -> float:
    """Share of the shingles that the passage holds; an empty part is held."""
    return sum(g in have[len(g)] for g in wanted) / len(wanted) if wanted else 1.0


def _best(found: list[tuple]) -> list[tuple]:
    best: dict[int, tuple] = {}
    for x in found:
        if x[0] not in best or x[1:] > best[x[0]][1:]:
            best[x[0]] = x
    return sorted(best.values())


def item_shards(items: DataFrame, item_col: str = "item_id", text_col: str = "text", question_col: str | None = None, answer_col: str | None = None, most: int = MOST_ITEMS, answer_share: float = 0.0) -> Iterator[ItemIndex]:
    """Indexes of the items, each of bounded size. Items with a null id or without a word are left out.

    Without question and answer columns an item is one whole, unless `answer_share` of its words, the last ones,
    are to be held as well for themselves.
    """
    rows = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long"), *(F.col(c) for c in ((question_col, answer_col) if question_col else (text_col,))))
    part: list[tuple] = []
    held = 0
    for row in rows.toLocalIterator():
        if question_col:
            question, answer = row[1] or "", row[2] or ""
        else:
            words = (row[1] or "").split()
            cut = len(words) - int(len(words) * answer_share)
            question, answer = " ".join(words[:cut]), " ".join(words[cut:])
        part.append((row[0], question, answer))
        held += len(question) + len(answer)
        if len(part) >= most or held >= MOST_BYTES:
            yield ItemIndex(part)
            part, held = [], 0
    if part:
        yield ItemIndex(part)


def _matches(df: DataFrame, index: ItemIndex, retrieve: float, overlap: float) -> Column:
    shared = df.sparkSession.sparkContext.broadcast(index)
    names = ("item_id", "score", "question_overlap", "answer_overlap")

    def find(texts: pd.Series) -> pd.Series:
        all_, out = texts.tolist(), []
        for lo, hi in chunks(all_, len(all_), 1 << 20):
            out += [[dict(zip(names, x)) for x in found] for found in shared.value.find(all_[lo:hi], retrieve, overlap)]
        return pd.Series(out, dtype=object)

    return F.pandas_udf(find, MATCHES)


def find_leaks(df: DataFrame, items: DataFrame, text_col: str = "text", retrieve: float = RETRIEVE, overlap: float = OVERLAP, leaks_col: str = "leaks", **columns) -> DataFrame:
    """`df` with `leaks_col`, the array of benchmark items (id, score, overlaps) that a passage of the text holds: whole, or question and answer where the items have both columns.

    The overlap of an item without an answer is its `question_overlap`; the empty answer counts as held (1.0).

    Every passage of every whole text is a query; passages overlap by half and are at least twice as long as the
    longest item. Words are lower-cased runs of word characters. Null and empty texts, an empty table and empty
    items give no leaks; equal items each match; repeated rows are treated alike; a column named like `leaks_col` is
    replaced, others pass through. A text is searched whole, in memory of some 50 times its size. Items beyond one
    index are searched index after index, each in a pass of its own whose few matches are checkpointed, so that one
    index at a time is broadcast.
    """
    bounded_batches(df.sparkSession)
    shards = item_shards(items, **columns)
    first, second = next(shards, None), next(shards, None)
    kept = [c for c in df.columns if c.lower() != leaks_col.lower()]
    if first is None:
        return df.select(*kept, F.array().cast(MATCHES).alias(leaks_col))
    if second is None:
        return df.select(*kept, _matches(df, first, retrieve, overlap)(F.col(text_col).cast("string")).alias(leaks_col))
    row, of, some = fresh(df, "row", "of", "some")
    d = checkpoint(df.withColumn(row, F.monotonically_increasing_id()))
    found = None
    for index in (first, second, *shards):
        part = d.select(F.col(row).alias(of), _matches(df, index, retrieve, overlap)(F.col(text_col).cast("string")).alias(some)).where(F.size(some) > 0)
        part = checkpoint(part)
        found = part if found is None else found.unionByName(part)
    found = found.groupBy(of).agg(F.array_sort(F.flatten(F.collect_list(some))).alias(some))
    d = d.join(found, d[row] == found[of], "left")
    return d.select(*kept, F.coalesce(some, F.array().cast(MATCHES)).alias(leaks_col))


def decontaminate(df: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of `df` without leaks, all columns as they are, also one named `leaks`."""
    (leaks,) = fresh(df, "leaks")
    return find_leaks(df, items, text_col, leaks_col=leaks, **options).where(F.size(leaks) == 0).select(*df.columns)
