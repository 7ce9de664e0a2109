"""Language identification by prediction by partial matching (PPM) over bytes, with frozen statistics."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Longest context in bytes.
ORDER = 3
#: About so many labelled documents of each language, and bytes of them, are learned from: whole texts, chosen by a hash
#: of their id. All that they hold is counted; it bounds what is broadcast, to 24 bytes for each different gram.
SAMPLE_DOCS, SAMPLE_BYTES = 1000, 8 << 20
#: Grams that are looked up at once.
SLICE = 1 << 20
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, mod 4, is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def grams(data: np.ndarray, length: int) -> np.ndarray:
    """Big-endian number of the `length` bytes that end at each position from ORDER on."""
    out = np.zeros(max(0, len(data) - ORDER), dtype=np.uint64)
    for k in range(length):
        out |= data[ORDER - k : len(data) - k].astype(np.uint64) << np.uint64(8 * k)
    return out


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts, A-Z lower-cased, ORDER zero bytes before each; where each begins among the grams, and its length."""
    gap = bytes(ORDER)
    data = np.frombuffer(b"".join(x for t in texts for x in (gap, t.lower())), dtype=np.uint8)
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    return data, np.cumsum(size + ORDER) - size - ORDER, size


class ContextTree:
    """Code lengths in bits of a byte after its context, in one language.

    Escapes follow method C: a context seen T times with q different bytes gives a byte seen n times n / (T + q)
    and the escape to the next shorter context q / (T + q); below order 0 all 256 bytes are alike.
    """

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """counts: for gram lengths 1 to ORDER + 1, the sorted keys and how often each was seen."""
        self.levels: list[tuple[np.ndarray, ...]] = []
        for length, (keys, n) in enumerate(counts, 1):
            contexts, first, of = np.unique(keys >> np.uint64(8), return_index=True, return_inverse=True)
            total = np.add.reduceat(n, first).astype(np.float64) if len(first) else np.zeros(0)
            kinds = np.diff(np.append(first, len(keys))).astype(np.float64)
            self.levels.append((keys, np.log2((total + kinds)[of] / n), contexts, np.log2((total + kinds) / kinds)))

    def bits(self, keys: np.ndarray, length: int = ORDER + 1) -> np.ndarray:
        """Code length of the last byte of each gram."""
        if not length:
            return np.full(len(keys), 8.0)
        seen, bits, contexts, escape = self.levels[length - 1]
        at, hit = _find(seen, keys)
        out = np.zeros(len(keys))
        out[hit] = bits[at[hit]]
        if not hit.all():
            rest = keys[~hit]
            c, known = _find(contexts, rest >> np.uint64(8))
            cost = np.zeros(len(rest))
            cost[known] = escape[c[known]]
            out[~hit] = cost + self.bits(rest & np.uint64((1 << (8 * (length - 1))) - 1), length - 1)
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key among the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class ContextTrees:
    """A context tree for each language."""

    def __init__(self, trees: dict[str, ContextTree]) -> None:
        self.languages = sorted(trees)
        self.trees = [trees[k] for k in self.languages]

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of every whole text (a row) under each language (a column). Different grams are looked up once a slice."""
        data, start, size = joined(texts)
        out = np.zeros((len(texts), len(self.trees)))
        for lo in range(0, max(0, len(data) - ORDER), SLICE):
            keys, which = np.unique(grams(data[lo : lo + SLICE + ORDER], ORDER + 1), return_inverse=True)
            at = np.arange(lo, lo + len(which))
            text = np.searchsorted(start, at, side="right") - 1
            inside = at < start[text] + size[text]  # not of the padding before the next text
            for j, tree in enumerate(self.trees):
                out[:, j] += np.bincount(text[inside], tree.bits(keys)[which[inside]], minlength=len(texts))
        return out


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> ContextTrees:
    """Context trees of the labelled documents that are not held out, from a sample of whole texts.

    Of each language about `sample_docs` are read, and fewer where they would be over `sample_bytes`; their counts are
    kept whole. Rows without a language or text teach nothing; repeated rows and a null id count like others; a table
    with nothing to learn from gives no languages.
    """
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    rows = rows.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = {r["lang"]: (r["n"], r["bytes"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()}
    languages = sorted(sizes)
    if not languages:
        return ContextTrees({})
    share = {k: min(1.0, sample_docs / n, sample_bytes / max(1, size)) for k, (n, size) in sizes.items()}
    of = F.create_map(*(F.lit(x) for k in languages for x in (k, share[k])))
    chosen = rows.where(F.pmod(F.xxhash64(F.lit(7), F.coalesce("id", F.lit(""))), F.lit(1 << 30)) < of[F.col("lang")] * (1 << 30))
    number = F.create_map(*(F.lit(x) for j, k in enumerate(languages) for x in (k, j)))

    def make():
        def work(part: list[tuple]) -> Iterable[tuple]:
            by: dict[int, list[bytes]] = {}
            for text, lang in part:
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                data, start, size = joined(texts)
                own = np.ones(max(0, len(data) - ORDER), dtype=bool)
                for k in range(1, len(texts)):
                    own[start[k] - ORDER : start[k]] = False
                for length in range(1, ORDER + 2):
                    keys, n = np.unique(grams(data, length)[own], return_counts=True)
                    yield from ((lang, length, int(k), int(c)) for k, c in zip(keys, n))

        return work

    schema = pa.schema([("lang", pa.int32()), ("length", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())])
    found = map_rows(chosen.select("text", number[F.col("lang")].alias("lang")), make, schema, "lang int, length int, gram long, n long", size_of=0)
    t = found.groupBy("lang", "length", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang, length, gram, n = (t[c].to_numpy() for c in ("lang", "length", "gram", "n"))
    trees = {}
    for j, name in enumerate(languages):
        counts = []
        for k in range(1, ORDER + 2):
            part = np.flatnonzero((lang == j) & (length == k))
            part = part[np.argsort(gram[part])]
            counts.append((gram[part].astype(np.uint64), n[part]))
        trees[name] = ContextTree(counts)
    return ContextTrees(trees)


def identify(df: DataFrame, trees: ContextTrees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, lang_pred, score, bits_per_byte): the language with the shortest code for each whole text.

    Only the text decides. score is the winner's probability where all languages are alike beforehand. A null
    text, one without a letter, and every text where nothing was learned are `und` with score 0; of languages
    with equal lengths (a tie) the alphabetically first wins. Null ids and repeated rows keep their rows; an empty
    table gives an empty result; columns other than the two named are left out, whatever their names. A whole text
    is coded, however long: its grams are looked up in slices, so that a text takes some 30 times its size in memory
    whatever the number of languages.
    """
    shared = df.sparkSession.sparkContext.broadcast(trees)

    def make():
        own = shared.value

        def work(rows: list[tuple]) -> Iterable[tuple]:
            texts = [t or "" for _, t in rows]
            raw = [t.encode() for t in texts]
            bits = own.code_lengths(raw) if own.languages else np.zeros((len(rows), 1))
            best = bits.argmin(axis=1) if own.languages else None
            score = 1 / np.exp2(np.maximum(bits.min(axis=1)[:, None] - bits, -1000)).sum(axis=1)
            for k, (i, _) in enumerate(rows):
                if own.languages and any(map(str.isalpha, texts[k])):
                    yield i, own.languages[best[k]], float(score[k]), float(bits[k, best[k]] / len(raw[k]))
                else:
                    yield i, UNKNOWN, 0.0, None

        return work

    schema = pa.schema([("id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])
    return map_rows(df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), make, schema, "id long, lang_pred string, score double, bits_per_byte double", chunk_bytes=1 << 20, size_of=1)
