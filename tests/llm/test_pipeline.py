import base64
import hashlib
import re
from collections import Counter

import corpus_pipeline
import numpy as np
from pyspark.sql import Row
from lexivane.llm import decontaminate, lines, quality, simhash

from .test_text_operators import whole_leaks


WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_groups(rows):
    """{doc_id: smallest doc_id reachable over texts whose sets of five-word shingles have a Jaccard similarity of 0.8}."""
    sets = []
    for r in rows:
        w = WORDS.findall(r["text"].encode().lower())
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    least = [r["doc_id"] for r in rows]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if least[i] != least[j] and len(a & b) >= 0.8 * len(a | b):
                lo, hi = sorted((least[i], least[j]))
                least = [lo if x == hi else x for x in least]
    return {r["doc_id"]: x for r, x in zip(rows, least)}


def norm(line):
    return "".join(" " if c in "\t\n\v\f\r" else c for c in line).lower().strip(" ")


def has_word(line):
    return re.search(r"[^\x20\x09-\x0D]", line) is not None


def brute_quality(rows, limit=quality.HOST_LIMIT, min_left=quality.MIN_LEFT):
    """{doc_id: text} after the quality rules, in plain Python."""
    docs = {}
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            if has_word(line):
                docs.setdefault((r["source"], norm(line)), set()).add(r["doc_id"])
    out = {}
    for r in rows:
        text = r["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        often = Counter(grams)
        repeated = {k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(3)}
        over = [has_word(x) and len(docs[r["source"], norm(x)]) > limit and min(docs[r["source"], norm(x)]) != r["doc_id"] for x in text.split("\n")]
        chars = [len("".join(re.findall(r"[^\x20\x09-\x0D]+", x))) for x in text.split("\n")]
        left = sum(c for c, gone in zip(chars, over) if not gone)
        if len(words) >= 50 and 100 * len(repeated) <= 50 * len(words) and left >= min_left * sum(chars):
            out[r["doc_id"]] = "\n".join(x for x, gone in zip(text.split("\n"), over) if not gone)
    return out


def brute_lines(rows, min_sites=lines.MIN_SITES, min_words=lines.MIN_WORDS):
    """{doc_id: text} after line dedup, in plain Python."""
    long = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x)) >= min_words
    sites, first = {}, {}
    for r in rows:
        for x in map(norm, r["text"].split("\n")):
            if long(x):
                sites.setdefault(x, set()).add(r["source"])
                first[x] = min(first.get(x, r["doc_id"]), r["doc_id"])
    out = {}
    for r in rows:
        kept = [x for x in r["text"].split("\n") if not (long(norm(x)) and len(sites[norm(x)] - {None}) >= min_sites and first[norm(x)] != r["doc_id"])]
        if len(kept) == len(r["text"].split("\n")) or any(map(has_word, kept)):
            out[r["doc_id"]] = "\n".join(kept)
    return out


def test_near_dedup_finds_planted_copies(spark):
    """Texts of similarity 0.8 to 0.95 to another among many: all documents, those with an id divisible by 50 as queries."""
    rng, rows = np.random.default_rng(11), []
    for k in range(1500):
        words = [f"v{int(x)}" for x in rng.integers(0, 900, size=int(rng.integers(40, 200)))]
        rows.append((k, " ".join(words)))
        if k % 50 == 0:
            for j in range(3):
                near = list(words)
                for at in rng.integers(0, len(words), size=max(1, len(words) // 60)):
                    near[at] = "changed"
                rows.append((10_000 + 10 * k + j, " ".join(near)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in simhash.similar_groups(df).collect()}
    want = brute_groups(df.collect())
    assert got == want and sum(want[i] != i for i, _ in rows) > 50


def test_stages_in_order_and_their_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "bpe_tokens"]
    columns = docs.columns
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf)
        if name != "bpe_tokens":
            assert after.columns == columns
            after = spark.createDataFrame(after.collect(), docs.schema)
        if name in ("quality_rules", "line_dedup"):
            want = (brute_quality if name == "quality_rules" else brute_lines)(before.collect())
            assert {r["doc_id"]: r["text"] for r in after.collect()} == want and len(want) > 50
            assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
        if name == "near_dedup":
            assert {r["doc_id"] for r in after.collect()} == set(brute_groups(before.collect()).values())
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
            assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect() if not whole_leaks(r["text"], items)}
        if name == "bpe_tokens":
            want = {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in before.collect()}
            assert {r["doc_id"]: r["decoded_sha256"] for r in after.collect()} == want
        before = after


def test_stages_on_lines_that_many_documents_share(spark, sf):
    """Both line stages where their limits bite: shared lines in one host and over many sites."""
    rows = []
    for k in range(90):
        own = [" ".join(f"own{k}x{i}y{j}" for j in range(9)) for i in range(8)]
        shared = [f"Menu of host {k % 2} and more", "All Sites carry this line", "  all sites carry THIS line\t", "two words", ""]
        rows.append((k, "\n".join([*shared[: 1 + k % 5], *own, *(f"shared tail {j} of the host {k % 3}" for j in range(30 if k % 7 == 0 else 1))]), "en", f"s{k % 12}" if k % 4 else "hot", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for stage, brute in ((corpus_pipeline.quality_rules, brute_quality), (corpus_pipeline.line_dedup, brute_lines)):
        got = {r["doc_id"]: r["text"] for r in stage(spark, docs, sf).collect()}
        assert got == brute(docs.collect()) and any(t != rows[i][1] for i, t in got.items())


def test_run_equals_the_stages(spark, sf):
    """The rows of run() are those of the stages one after the other, held in plain Python up to the tokens."""
    import public_tokenizers
    import tiktoken

    done = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    for brute in (brute_quality, brute_lines):
        kept = brute(docs)
        docs = [Row(doc_id=r["doc_id"], text=kept[r["doc_id"]], source=r["source"]) for r in docs if r["doc_id"] in kept]
    first = set(brute_groups(docs).values())
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = {r["doc_id"]: r["text"] for r in docs if r["doc_id"] in first and not whole_leaks(r["text"], items)}
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {i: list(r["ids"]) for i, r in done.items()} == {i: enc.encode_ordinary(t) for i, t in want.items()}


def test_odd_rows_pass_through_all_stages(spark, odd, none, sf):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, sf).collect(), stage(spark, docs, sf).schema)
    assert decontaminate.OVERLAP >= 0.8
