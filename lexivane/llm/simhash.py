"""SimHash near-duplicates by a self-join of a binary trie over the fingerprints."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpoint, connected_components, fresh, map_rows, to_batches

SEED = 42
#: A node of the upper trie with more fingerprints than NODE_ROWS is cut, and with more than a MIN_NODES-th of all,
#: so that small inputs keep the executors busy too; never one with less than a MOST_NODES-th, which bounds the nodes.
NODE_ROWS, MIN_NODES, MOST_NODES = 250_000, 16, 8_192
#: Levels of the upper trie that one aggregate counts.
LEVELS = 6
#: Node pairs that a step of the traversal works on.
FRONTIER = 200_000
#: Links of texts ask for this Jaccard similarity of their sets of SIMILAR_WIDTH-word shingles, counted exactly.
SIMILAR, SIMILAR_WIDTH = 0.8, 5
#: Bits that the trie allows where texts are compared afterwards. A similarity of 0.8 is a cosine of 0.89, for which
#: 9.7 of 64 bits differ (standard deviation 2.9): out of reach of any trie, as a budget b visits about C(log2 n, b)
#: node pairs a fingerprint.
SIMILAR_BITS = 3
#: What is further apart is found by MinHash: texts that agree in all BAND_ROWS minima of one of BANDS bands are
#: compared too. A pair of similarity s meets in a band with probability 1 - (1 - s ** BAND_ROWS) ** BANDS: 0.99993 at 0.8.
BANDS, BAND_ROWS = 24, 5
#: Texts, and words, that are compared with each other in one place; larger groups are cut into pairs of blocks.
BLOCK_TEXTS, BLOCK_WORDS = 1_000, 2_000_000
SALTS = 16


def fingerprint(data: bytes, width: int) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles, 0 where it has no word."""
    return _simhash(shingle_hashes(data, width)) if data.split() else 0


def shingle_hashes(data: bytes, width: int) -> np.ndarray:
    """XXH64 of a text's word shingles in their order; fewer words, or none, are one shingle."""
    words = data.lower().split()
    flat = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(flat, SEED)], dtype="<u8")
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    return np.fromiter((xxhash.xxh64_intdigest(flat[a : b - 1], SEED) for a, b in zip(starts, starts[width:])), dtype="<u8", count=len(words) - width + 1)


def _simhash(hashes: np.ndarray) -> int:
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[lo : lo + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """Rows (id, fp): each text's fingerprint as a signed long. Null text counts as empty."""

    def make():
        return lambda rows: [(i, _signed(fingerprint(t or b"", width))) for i, t in rows]

    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])
    return map_rows(df.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")), make, schema, "id long, fp long", size_of=1)


def trie_links(codes: np.ndarray, frontier: list[np.ndarray], width: int, budget: int, visits: Counter | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of distinct codes at `budget` differing bits at most, from pairs of trie nodes.

    A node is a range of the sorted `codes` that shares its upper bits. The traversal goes down both nodes of
    a pair together, adds a bit to its count of differences where it takes different children, and drops the
    pair once that exceeds the budget. Nodes of one code have one path left, whose bits are compared at once.
    frontier: arrays a0, a1, b0, b1 (ranges) and diff of the first pairs; a pair of a node with itself has equal
    ranges. The stack is worked depth first in slices of bounded length. `visits` counts node pairs by bit.
    """
    ones: dict[int, np.ndarray] = {}
    stack = [(width - 1, *frontier)]
    while stack:
        bit, a0, a1, b0, b1, diff = stack.pop()
        if len(a0) > FRONTIER:
            stack += [(bit, *(x[k : k + FRONTIER] for x in (a0, a1, b0, b1, diff))) for k in range(0, len(a0), FRONTIER)]
            continue
        own = a0 == b0
        live = (a1 > a0) & (b1 > b0) & (diff <= budget) & ~(own & (a1 - a0 < 2))
        a0, a1, b0, b1, diff, own = (x[live] for x in (a0, a1, b0, b1, diff, own))
        if not len(a0):
            continue
        if visits is not None:
            visits[bit] += len(a0)
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            i, j = a0[single], b0[single]
            near = np.bitwise_count(codes[i] ^ codes[j]) <= budget
            yield i[near], j[near]
            a0, a1, b0, b1, diff, own = (x[~single] for x in (a0, a1, b0, b1, diff, own))
            if not len(a0):
                continue
        if bit not in ones:
            ones[bit] = np.concatenate(([0], np.cumsum((codes >> np.uint64(bit)) & np.uint64(1), dtype=np.int32)), dtype=np.int32)
        c = ones[bit]
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        cross = ~own
        parts = [(a0, am, b0, bm, diff), (am, a1, bm, b1, diff), (a0, am, bm, b1, diff + 1), (am[cross], a1[cross], b0[cross], bm[cross], diff[cross] + 1)]
        stack.append((bit - 1, *(np.concatenate(x) for x in zip(*parts))))


def upper_trie(prints: DataFrame, node_rows: int = NODE_ROWS) -> list[tuple[int, int]]:
    """(prefix, depth) of the nodes that the trie of all `fp` is cut into, in their order; each has a bounded share.

    Only counts of nodes reach the driver: those below the heavy nodes, of which there are MOST_NODES at most.
    """
    total = prints.count()
    limit = max(min(node_rows, total // MIN_NODES), total // MOST_NODES, 1)
    nodes: list[tuple[int, int]] = []

    def cut(prefix: int, depth: int, counts: list[tuple[int, int]], below: int) -> Iterator[int]:
        """Split a node by the counts (prefix, n) of its descendants at depth `below`; yields those still too heavy."""
        n = sum(c for _, c in counts)
        if n and (n <= limit or depth == 64):
            nodes.append((prefix, depth))
        elif n and depth == below:
            yield prefix
        elif n:
            for child in (2 * prefix, 2 * prefix + 1):
                yield from cut(child, depth + 1, [x for x in counts if x[0] >> (below - depth - 1) == child], below)

    heavy, depth = [0], 0
    while heavy:
        below = min(64, depth + LEVELS)
        rows = prints.select(F.expr(f"shiftrightunsigned(fp, {64 - below})").alias("p"))
        if depth:
            of = prints.sparkSession.createDataFrame([(h,) for h in heavy], "h long")
            rows = rows.join(F.broadcast(of), F.expr(f"shiftrightunsigned(p, {below - depth}) = h"))  # MOST_NODES rows at most
        found: dict[int, list[tuple[int, int]]] = {h: [] for h in heavy}
        for r in rows.groupBy("p").count().collect():
            p = r["p"] % (1 << 64)
            found[p >> (below - depth)].append((p, r["count"]))
        heavy = [x for h in heavy for x in cut(h, depth, found[h], below)]
        depth = below
    return sorted(nodes, key=lambda x: x[0] << (64 - x[1]))


def node_pairs(nodes: list[tuple[int, int]], budget: int) -> list[tuple[int, int, int]]:
    """(node, node, differing bits) of the pairs that the traversal of the upper trie ends in, the smaller node first."""
    tree: dict[tuple[int, int], int] = {(p, d): k for k, (p, d) in enumerate(nodes)}
    inner = {(p >> k, d - k) for p, d in nodes for k in range(1, d + 1)}
    out = []
    stack = [((0, 0), (0, 0), 0)]
    while stack:
        a, b, diff = stack.pop()
        if diff > budget or not all(x in tree or x in inner for x in (a, b)):
            continue
        ends = a in tree, b in tree
        if all(ends):
            out.append((tree[a], tree[b], diff))
            continue
        below = [[x] if end else [(2 * x[0], x[1] + 1), (2 * x[0] + 1, x[1] + 1)] for x, end in zip((a, b), ends)]
        # Below an end the other's bits are not told apart here; a pair of a node with itself has one mixed pair.
        known = not any(ends)
        stack += [(x, y, diff + (known and i != j)) for i, x in enumerate(below[0]) for j, y in enumerate(below[1]) if a != b or i <= j]
    return sorted(out)


def fingerprint_links(nodes: DataFrame, budget: int = 2, node_rows: int = NODE_ROWS) -> DataFrame:
    """Rows (src, dst) of distinct fingerprints `fp` within `budget` bits; they span every linked group.

    The upper trie is traversed on the driver. The node pairs it ends in are the tasks, and each goes on down
    from there, bit by bit; together they visit every pair of nodes within the budget, so no link is lost.
    """
    ends = upper_trie(nodes, node_rows)
    pairs = node_pairs(ends, budget)
    spark = nodes.sparkSession
    if not pairs:
        return spark.createDataFrame([], "src long, dst long")
    tasks = np.array(pairs, dtype=np.int64)
    by_node = _by_node(tasks, len(ends))
    plan = spark.sparkContext.broadcast({  # MOST_NODES bounds the nodes, and the budget the pairs of each
        "starts": np.array([p << (64 - d) for p, d in ends], dtype=np.uint64), "depths": np.array([d for _, d in ends]),
        "tasks": tasks, "flat": np.concatenate(by_node).astype(np.int32), "size": np.array([len(x) for x in by_node]),
    })

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = plan.value
        first = np.cumsum(own["size"]) - own["size"]
        for batch in batches:
            fp = batch.column(0).to_numpy()
            node = np.searchsorted(own["starts"], fp.view(np.uint64), side="right") - 1
            n = own["size"][node]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[node], n)
            yield pa.RecordBatch.from_arrays([pa.array(own["flat"][at]), pa.array(np.repeat(fp, n))], names=["task", "fp"])

    def links(task: int, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        own = plan.value
        a, b, diff = own["tasks"][task].tolist()
        codes = np.sort(codes.view(np.uint64))
        cut = len(codes) if a == b else int(np.searchsorted(codes, own["starts"][b]))
        ranges = (0, cut, 0, cut) if a == b else (0, cut, cut, len(codes))
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        depth = int(min(own["depths"][a], own["depths"][b]))
        for i, j in trie_links(codes, [np.array([x]) for x in (*ranges, diff)], 64 - depth, budget):
            for x, y in zip(i.tolist(), j.tolist()):
                p, q = find(x), find(y)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    yield _signed(int(codes[x])), _signed(int(codes[y]))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])
        now, held = None, []
        for batch in batches:
            task, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(task)) + 1).tolist(), len(task)]
            for lo, hi in zip(cut, cut[1:]):
                if hi > lo:
                    if held and task[lo] != now:
                        yield from to_batches(links(now, np.concatenate(held)), schema)
                        held = []
                    now = int(task[lo])
                    held.append(fp[lo:hi])
        if held:
            yield from to_batches(links(now, np.concatenate(held)), schema)

    dealt = nodes.select("fp").mapInArrow(deal, "task int, fp long")
    return dealt.repartition("task").sortWithinPartitions("task").mapInArrow(join, "src long, dst long")


def _by_node(tasks: np.ndarray, n: int) -> list[np.ndarray]:
    """Numbers of the tasks that each node is part of."""
    number = np.arange(len(tasks))
    mixed = tasks[:, 0] != tasks[:, 1]
    node, task = np.concatenate((tasks[:, 0], tasks[mixed, 1])), np.concatenate((number, number[mixed]))
    order = np.argsort(node, kind="stable")
    return np.split(task[order], np.searchsorted(node[order], np.arange(1, n)))


def _sketches(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Rows (id, node, fp, words, bands): node stands for the text's bytes, bands are hashes of its MinHash bands."""

    def make():
        rng = np.random.default_rng(SEED)
        flip, by = (rng.integers(0, 1 << 64, size=(1, BANDS * BAND_ROWS), dtype=np.uint64) for _ in range(2))
        by |= np.uint64(1)

        def sketch(i, node, text):
            h = shingle_hashes(text, width)
            least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
            for lo in range(0, len(h), 1024):
                np.minimum(least, ((h[lo : lo + 1024, None] ^ flip) * by).min(axis=0), out=least)
            bands = [_signed(xxhash.xxh64_intdigest(x.tobytes(), k)) for k, x in enumerate(least.reshape(BANDS, BAND_ROWS))]
            return i, node, _signed(_simhash(h)) if text.split() else 0, len(h), bands

        return lambda rows: [sketch(*r) for r in rows]

    schema = pa.schema([("id", pa.int64()), ("node", pa.int64()), ("fp", pa.int64()), ("words", pa.int64()), ("bands", pa.list_(pa.int64()))])
    return map_rows(_texts(df.select(F.col(id_col).cast("long").alias("id"), _bytes(text_col).alias("text"))).select("id", "node", "text"), make, schema, "id long, node long, fp long, words long, bands array<long>", size_of=2)


def _bytes(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary"))


def _texts(d: DataFrame) -> DataFrame:
    return d.withColumn("node", F.xxhash64("text"))


def _candidates(nodes: DataFrame, budget: int, node_rows: int) -> DataFrame:
    """Rows (src, dst) of nodes that may be similar, by bits or by a band; they span every group of candidates.

    Whatever shares a fingerprint or a band is tied to the smallest node that has it, so a large group of
    copies makes as many rows as it has texts.
    """
    prints = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    links = fingerprint_links(prints.select("fp"), budget, node_rows)
    first = lambda c: prints.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_node"))
    by_bits = links.join(first("src"), "src").join(first("dst"), "dst").select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst"))
    keys = nodes.select("node", F.explode(F.array_append("bands", F.xxhash64(F.lit("fp"), "fp"))).alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("dst"), F.max("node").alias("last")).where("dst <> last")
    shared = shared.select("key", "dst", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    by_key = keys.withColumn("salt", F.pmod("node", F.lit(SALTS)).cast("int")).join(shared, ["key", "salt"]).where("node <> dst")
    return by_bits.union(by_key.select(F.col("node").alias("src"), "dst"))


def _similar(hashes: list[np.ndarray], nodes: list[int], left: np.ndarray, right: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
    """Node pairs of Jaccard `least` or more between `left` and `right` texts; they span every linked group."""
    order = sorted(range(len(nodes)), key=lambda k: (len(hashes[k]), nodes[k]))
    size = np.array([len(hashes[k]) for k in order])
    left, right = left[order], right[order]
    group = np.arange(len(order))
    for i in range(1, len(order)):
        lo = int(np.searchsorted(size, least * size[i] - 1e-9))
        rest = np.arange(lo, i)[::-1]
        rest = rest[((left[rest] & right[i]) | (right[rest] & left[i])) & (group[rest] != group[i])]
        own = hashes[order[i]]
        while len(rest):
            j, rest = rest[0], rest[1:]
            both = len(np.intersect1d(own, hashes[order[j]], assume_unique=True))
            if both >= least * (size[i] + size[j] - both) - 1e-9:
                yield nodes[order[i]], nodes[order[j]]
                group[group == group[j]] = group[i]
                rest = rest[group[rest] != group[i]]


def _verified(rows: DataFrame, width: int, least: float) -> DataFrame:
    """Rows (src, dst) that span what is linked by `least`, from rows (root, pa, pb, block, node, text)."""
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])
    keys = ["root", "pa", "pb"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links():
            now, held = None, []
            for batch in batches:
                for *key, block, node, text in zip(*(c.to_pylist() for c in batch.columns)):
                    if key != now:
                        yield from compare(now, held)
                        now, held = key, []
                    held.append((block, node, np.unique(shingle_hashes(text, width))))
            yield from compare(now, held)

        def compare(key, held):
            if len(held) > 1:
                block = np.array([b for b, _, _ in held])
                yield from _similar([h for *_, h in held], [n for _, n, _ in held], block == key[1], block == key[2], least)

        yield from to_batches(links(), schema)

    bounded_batches(rows.sparkSession)
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "src long, dst long")


def similar_links(df: DataFrame, nodes: DataFrame, text_col: str, width: int, budget: int, node_rows: int, least: float = SIMILAR) -> DataFrame:
    """Rows (src, dst) of nodes whose shingle sets have a Jaccard similarity of `least`; they span every linked group.

    Candidates only say which texts meet: within each of their groups every pair of texts is compared exactly,
    but for pairs that links already join. A group over BLOCK_TEXTS texts or BLOCK_WORDS words is cut into blocks
    that meet in pairs, so that no task holds all of it.
    """
    found = checkpoint(_candidates(nodes, budget, node_rows))
    groups = checkpoint(connected_components(found).join(nodes.select("node", "words"), "node"))
    size = groups.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("words") / BLOCK_WORDS)).cast("int").alias("n"))
    members = groups.select("node", "root").join(size, "root").withColumn("block", F.pmod(F.xxhash64(F.lit(1), "node"), F.col("n")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.struct(F.least("block", k).alias("pa"), F.greatest("block", k).alias("pb")))
    texts = _texts(df.select(_bytes(text_col).alias("text"))).join(members, "node").dropDuplicates(["node"])
    return _verified(texts.withColumn("p", F.explode(meets)).select("root", "p.pa", "p.pb", "block", "node", "text"), width, least)


def _grouped(rows: DataFrame, key: str, links: DataFrame) -> DataFrame:
    """Rows (id, key, component_id) of the rows (id, key, ...): the smallest id that links of keys reach."""
    nodes = rows.groupBy(key).agg(F.min("id").alias("least"))
    placed = nodes.join(connected_components(links).withColumnRenamed("node", key), key, "left").withColumn("root", F.coalesce("root", key))
    lowest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("id", key).join(placed.join(lowest, "root").select(key, "component_id"), key)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 2, node_rows: int = NODE_ROWS) -> DataFrame:
    """Rows (id, fp, component_id): the fingerprint of each whole text, and the smallest id reachable over links.

    A link is a pair of fingerprints within `budget` bits; equal fingerprints fall together before the search. A
    null text counts as empty and has fingerprint 0 like every text without a word; rows with a null id keep
    their row and are grouped like others (the component of rows whose ids are all null is null); repeated rows
    and ids keep their rows; ties have no say, as the smallest id is one value; an empty table gives an empty
    result. Other columns of `df` are left out, whatever their names. A text is hashed whole, in memory of some
    20 times its size.
    """
    prints = checkpoint(fingerprints(df, id_col, text_col, width))
    return _grouped(prints, "fp", fingerprint_links(prints.select("fp").distinct(), budget, node_rows)).select("id", "fp", "component_id")


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SIMILAR_WIDTH, budget: int = SIMILAR_BITS, node_rows: int = NODE_ROWS, least: float = SIMILAR) -> DataFrame:
    """Rows (id, component_id): the smallest id reachable over pairs of texts of Jaccard similarity `least`.

    The similarity is that of the sets of `width`-word shingles, counted exactly; `budget` bits and the MinHash
    bands only choose what is compared. Rows that `near_duplicates` treats specially are treated alike here;
    texts without a word are equal.
    """
    rows = checkpoint(_sketches(df, id_col, text_col, width))
    nodes = rows.groupBy("node").agg(*(F.first(c).alias(c) for c in ("fp", "words", "bands")))
    links = checkpoint(similar_links(df, nodes, text_col, width, budget, node_rows, least))
    return _grouped(rows, "node", links).select("id", "component_id")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `df` whose id is the smallest of its group in `similar_groups`; rows with a null id stay, as do all columns."""
    (gone,) = fresh(df, "gone")
    copies = similar_groups(df, id_col, text_col, **options).where("id <> component_id").select(F.col("id").alias(gone)).distinct()
    return df.join(checkpoint(copies), F.col(id_col).cast("long") == F.col(gone), "left_anti")
