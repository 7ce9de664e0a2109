import base64
import hashlib
import random

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from lexivane.llm import bpe, chat, decontaminate, language_id, licenses, lines, quality, queries, substring, urls

TABLES = ("documents", "pages", "conversations", "benchmark")


def rows(df, columns=None):
    return sorted((tuple(r) for r in df.select(*(columns or sorted(df.columns))).collect()), key=repr)


def ask(sql, sf=None, **frames):
    """Rows of DuckDB SQL, columns by name, over files or over rows of a DataFrame."""
    con = duckdb.connect()
    for t in TABLES if sf else ():
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    for name, df in frames.items():
        con.register(f"{name}_", df.toPandas().convert_dtypes(dtype_backend="pyarrow"))
        con.execute(f"create view {name} as select * from {name}_")
    d = con.execute(sql).df()
    d = d[sorted(d.columns)].astype(object)
    return sorted((tuple(None if x is None or x != x else x for x in r) for r in d.where(d.notna(), None).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, sf, name):
    assert rows(queries.QUERIES[name](spark, sf)) == ask(queries.ORACLE_SQL[name], sf)


def unique(odd):
    return odd.where("doc_id is not null").dropDuplicates(["doc_id"])


def test_quality_odd_rows(spark, odd, odd_rows, none):
    # Ids are unique in what is held against SQL; nulls and repeats are looked at below.
    assert rows(quality.judge(unique(odd)).withColumnRenamed("id", "doc_id")) == ask(quality.SQL, documents=unique(odd))
    assert quality.judge(odd).count() == len(odd_rows)
    assert quality.judge(none).count() == 0 and quality.keep_good(odd).columns == odd.columns


def test_quality_depletes_copies_but_not_the_first(spark):
    shared = "\n".join(" ".join(f"notice{i}x{k}" for k in range(6)) for i in range(12))
    own = "\n".join(" ".join(f"own{i}x{k}" for k in range(6)) for i in range(12))
    df = spark.createDataFrame([(i, shared if i % 2 else f"{own} {i}", "h") for i in range(60)], "doc_id long, text string, source string")
    kept = {r["id"]: r["kept"] for r in quality.judge(df, limit=20).collect()}
    assert kept[1] and not any(kept[i] for i in range(3, 60, 2))
    assert quality.judge(df, limit=30).where("kept").count() >= 30


def test_quality_takes_the_lines_out(spark):
    own = lambda i: [" ".join(f"own{i}x{k}y{j}" for j in range(8)) for k in range(8)]
    rows_ = [(i, "\n".join(["Home | News | About us", *own(i)[:4], "", "  home | news | about us", *own(i)[4:]]), "h") for i in range(1, 31)]
    rows_ += [(31, "\n".join(["Home | News | About us", *own(31)]), "other"), (32, None, None), (None, "\n".join(["home | news | About us", *own(33)]), "h")]
    df = spark.createDataFrame(rows_, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in quality.clean_good(df, limit=20).collect()}
    assert got.pop(1) == rows_[0][1] and got.pop(31) == rows_[30][1] and got.pop(None) == "\n".join(own(33))
    assert got == {i: "\n".join([*own(i)[:4], "", *own(i)[4:]]) for i in range(2, 31)}


def test_lines_odd_rows(spark, odd, none):
    got = lines.dedup_lines(odd, min_sites=2)
    assert got.count() == odd.count() and got.where("doc_id = 3").first()["text"] is None
    assert lines.dedup_lines(none).count() == 0
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[2]["n_removed_lines"] == 1 and by[2]["text"] == "" and by[1]["n_removed_lines"] == 0
    assert lines.clean_lines(odd, min_sites=2).where("doc_id = 2").count() == 0


def test_lines_threshold_is_exact(spark):
    df = spark.createDataFrame([(s * 10 + k, f"shared by {n} sites here\nown {s} {k} line text", f"s{s}") for n in (9, 10, 11) for s in range(n) for k in range(1)], "doc_id long, text string, source string")
    df = df.withColumn("doc_id", F.monotonically_increasing_id())
    gone = lines.dedup_lines(df, min_sites=10).where("n_removed_lines > 0")
    assert gone.count() == 9 + 10


def test_urls_odd_rows(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate([None, "", "no scheme", "http://", "http://COM", "http://a.COM/x", "https://www.example.com/en/1?q=/fr/", "https://example.com/en", "https://example.com/en/", "x://m.example.net/es/#/fr/", "x://notexample.net/es/", "http://com/", "http://user@a.com:80/en/", "a://b://c.com/"])], "page_id long, url string, rule string")
    got = urls.filter_urls(pages, urls.RULES)
    assert set(got.columns) == {"page_id", "url", "host", "path", "rule", "verdict"}
    assert rows(got.drop("url")) == ask(urls.SQL, pages=pages)
    assert urls.filter_urls(pages.limit(0), urls.RULES).count() == 0


def test_url_trie_takes_open_paths_and_the_longest():
    trie = urls.UrlTrie([("block", "a.com", "/x"), ("allow", "a.com", "/xy/z"), ("block", "com", "")])
    assert trie.find("b.a.com", "/xq") == ("a.com/x", "block")
    assert trie.find("a.com", "/xy/zoo") == ("a.com/xy/z", "allow")
    assert trie.find("b.com", "") == ("com", "block") and trie.find("b.org", "/") is None


def test_chat_round_trip_of_odd_texts(spark):
    rng = random.Random(3)
    bits = ["<|im_start|>", "<|im_end|>", "\\", "<\\|", "[INST]", "[/INST]", "</s>", "<s>", "\n", "a", " ", "<", "|", "\U0001f600"]
    says = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))
    data = [(c, t, rng.choice(["user", "assistant", "system", "odd\nrole %", None]), rng.choice([None, says(), says() * 40])) for c in range(12) for t in range(rng.randint(1, 9))]
    data += [(None, None, None, None), (5, 0, "user", "tie"), (5, 0, "user", "tie"), (77, 0, "system", "x" * 9000), (77, 1, "assistant", "y" * 9000)]
    df = spark.createDataFrame([(*r, "z") for r in data], "conv_id long, turn long, role string, text string, window string")
    windows = chat.format_windows(df)
    got = chat.read_back(windows).select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
    assert rows(got) == ask(chat.SQL.replace(" union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'", ""), conversations=df)
    over = windows.where((F.length("text") > chat.BUDGET * chat.CHARS_A_TOKEN) & (F.col("n_turns") > 1))
    assert over.count() == 0 and chat.format_windows(df.limit(0)).count() == 0


def test_bpe_matches_tiktoken(spark, sf, odd, odd_rows, none):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    letters = " \n\t\r\x0b\x1c\x85\xa0\u3000aàÉ你1٣'’!?#st reveml\U0001f600\u200d"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(800)] + ["ab" * 700, "!" * 300, " " * 300]
    texts += [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    with open(path, "rb") as f:
        own = bpe.Vocabulary(f, public_tokenizers.PATTERN)
    ids = own.encode(texts)
    assert ids == [enc.encode_ordinary(t) for t in texts]
    assert [own.decode(x) for x in ids] == [t.encode() for t in texts]
    got = bpe.encode(odd, path, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r["decoded"]) for r in got) == sorted((t or "").encode() for _, t, *_ in odd_rows)
    assert bpe.encode(none, path, public_tokenizers.PATTERN).count() == 0


def test_language_held_out_accuracy(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op1_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    trees = language_id.learn(docs)
    told = {r["id"]: r for r in language_id.identify(odd, trees).collect()}
    assert told[3]["lang_pred"] == told[4]["lang_pred"] == told[6]["lang_pred"] == "und" and told[1]["lang_pred"] == "en"
    assert language_id.identify(none, trees).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd, language_id.learn(none)).collect()} == {"und"}


def test_language_code_lengths_are_those_of_ppm(spark):
    """Against a direct computation of method C on a tiny corpus."""
    import math
    from collections import Counter

    train = {"x": [b"abracadabra", b"abab"], "y": [b"cccc dddd"]}
    df = spark.createDataFrame([(i, t.decode(), k) for i, (k, t) in enumerate([(k, t) for k in train for t in train[k]]) for _ in (0,)], "doc_id long, text string, lang string")
    df = df.where(~language_id.held_out(F.col("doc_id")))
    train = {}
    for r in df.collect():
        train.setdefault(r["lang"], []).append(r["text"].encode())
    trees = language_id.learn(df)
    pad = bytes(language_id.ORDER)

    def bits(lang, text):
        n = [Counter(d[i - k : i + 1] for t in train[lang] for d in [pad + t] for i in range(len(pad), len(d))) for k in range(language_id.ORDER + 1)]
        out, d = 0.0, pad + text
        for i in range(len(pad), len(d)):
            for k in range(language_id.ORDER, -2, -1):
                if k < 0:
                    out += 8
                    break
                seen = {g: c for g, c in n[k].items() if g[:-1] == d[i - k : i]}
                total, kinds = sum(seen.values()), len(seen)
                if d[i - k : i + 1] in seen:
                    out += math.log2((total + kinds) / seen[d[i - k : i + 1]])
                    break
                out += math.log2((total + kinds) / kinds) if kinds else 0
        return out

    texts = [b"abra", b"cd zz", b"", b"a"]
    got = trees.code_lengths(texts)
    for k, t in enumerate(texts):
        for j, lang in enumerate(trees.languages):
            assert got[k, j] == pytest.approx(bits(lang, t), rel=1e-4)


def test_substring_odd_rows(spark, odd, none):
    got = substring.remove_repeats(unique(odd)).select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
    assert rows(got) == ask(substring.SQL, documents=unique(odd))
    assert substring.remove_repeats(odd).count() == odd.count() and substring.remove_repeats(none).count() == 0
    twice = substring.remove_repeats(odd).where("id = 2").collect()
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0]["n_removed"] == 27


def test_substring_repetitive_texts(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(5, 60))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = substring.remove_repeats(df).select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
    assert rows(got) == ask(substring.SQL, documents=df)


def test_substring_small_chunks_and_hot_buckets(spark, sf, monkeypatch):
    """Many chunks and bins, and every shared bucket dealt out window by window, change nothing."""
    rng = random.Random(12)
    page = " ".join(rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(60))
    texts = [" ".join(rng.choice(["x", "y", "zz"]) for _ in range(rng.randint(0, 40))) + (f" {page}" if k % 3 else "") + f" end{k}" for k in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    digest = lambda d: rows(d.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256")))
    want = ask(substring.SQL, documents=df)
    for chunk, bins, hot, held in ((700, 900, 0, 400), (1, 1 << 20, 1, 2000), (1 << 20, 300, 5, 1 << 20), (1, 1 << 20, 0, 1)):
        for name, value in (("CHUNK_BYTES", chunk), ("BIN_BYTES", bins), ("HOT_STRINGS", hot), ("HELD_BYTES", held)):
            monkeypatch.setattr(substring, name, value)
        assert digest(substring.remove_repeats(df)) == want
        assert digest(substring.remove_repeats(spark.read.parquet(f"{sf}/documents.parquet").limit(80))) == ask(substring.SQL, documents=spark.read.parquet(f"{sf}/documents.parquet").limit(80))


def test_a_page_of_thousands_of_copies_stays_bounded(spark, monkeypatch):
    """Copies are counted in their chunks: what travels has a string for each chunk at most, and so has each bin."""
    monkeypatch.setattr(substring, "CHUNK_BYTES", 20_000)
    page = " ".join(f"word{i * 7919 % 1009}" for i in range(120))
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(page).alias("text")).repartition(4)
    found = substring.remove_repeats(df).groupBy("n_removed").count().collect()
    assert {r["n_removed"]: r["count"] for r in found} == {0: 1, 120: 4999}
    chunks = substring._chunks(df.select("doc_id", F.col("text").cast("binary"))).cache()
    entries = substring._buckets(chunks, 8, 13, 5).withColumn("n", F.length("entries") / 8)
    n_chunks, n_buckets = chunks.count(), entries.groupBy("chunk").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
    assert n_chunks > 100 and n_buckets < 60
    told = substring._by_bin(entries.drop("n"), substring._shared(substring.HOT_STRINGS), pa.schema([("chunk", pa.int64()), ("bin", pa.int64()), ("shared", pa.binary()), ("hot", pa.binary())]), "chunk long, bin long, shared binary, hot binary")
    told = told.groupBy("chunk").agg(F.collect_list(F.struct("bin", "shared", "hot")).alias("told"))
    travel = substring._strings(chunks.join(told, "chunk"), 8, 13, 5).where("bin >= 0").groupBy("bin").agg(F.sum(F.length("docs") / 8).alias("n"))
    assert travel.agg(F.sum("n")).first()[0] <= n_chunks * n_buckets and travel.agg(F.max("n")).first()[0] <= n_chunks * n_buckets / 2


def brute_leaks(text, items):
    """Items that a passage holds by overlap alone, without the index."""
    w = decontaminate.tokens(text)
    width = max(decontaminate.PASSAGE, 2 * max(len(decontaminate.tokens(t)) for _, t in items))
    found = set()
    for lo in range(0, max(1, len(w) - width // 2), width // 2):
        have = {n: decontaminate._all_shingles(w[lo : lo + width], n) for n in range(1, 6)}
        for i, t in items:
            x = t.split()
            cut = len(x) - int(len(x) * decontaminate.ANSWER_SHARE)
            parts = (decontaminate.shingles(decontaminate.tokens(" ".join(p))) for p in (x[:cut], x[cut:]))
            if all(decontaminate._share(p, have) >= 0.8 for p in parts):
                found.add(i)
    return found


def test_decontamination_matches_brute_force(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 6000").select("doc_id", "text").limit(300)
    got = {(r["doc_id"], x["item_id"]) for r in decontaminate.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect() for x in r["leaks"]}
    assert got == {(r["doc_id"], i) for r in docs.collect() for i in brute_leaks(r["text"], items)}
    bench = spark.createDataFrame([(1, items[0][1]), (1, items[0][1]), (None, "null id"), (2, None), (3, "")], "item_id long, text string")
    planted = odd.withColumn("text", F.when(F.col("doc_id") == 7, F.concat("text", F.lit(" " + items[0][1]))).otherwise(F.col("text")))
    assert [r["doc_id"] for r in decontaminate.find_leaks(planted, bench).where("size(leaks) > 0").collect()] == [7]
    assert decontaminate.decontaminate(planted, bench).count() == odd.count() - 1
    assert decontaminate.decontaminate(none, bench).count() == 0 and decontaminate.decontaminate(odd, bench.limit(0)).count() == odd.count()


def test_items_without_answer_count_as_a_whole(spark):
    items = [(n, " ".join(f"item{n}word{k}" for k in range(n))) for n in (30, 36, 55)]
    texts, want = [], []
    for n, item in items:
        for k in range(n):
            w = item.split()
            w[k] = "changed"
            have = {5: decontaminate._all_shingles(w, 5)}
            texts.append("some prose before " + " ".join(w) + " and after it")
            want.append(decontaminate._share(decontaminate.shingles(item.split()), have) >= 0.8)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontaminate.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).orderBy("doc_id").collect()
    assert [bool(r["leaks"]) for r in found] == want and sum(want) > 90


def test_wand_retrieves_all_above_threshold():
    rng = random.Random(2)
    vocab = [f"t{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(12)), "end") for i in range(50)]
    index = decontaminate.ItemIndex(items)
    for _ in range(60):
        terms = sorted(rng.sample(range(len(index.terms)), rng.randint(1, 20)))
        for least in (0.1, 0.4, 0.7):
            score = {}
            for t in terms:
                for n, x in index.postings[t]:
                    score[n] = score.get(n, 0) + x
            got = dict(index.search(terms, least))
            assert {n for n, s in score.items() if s >= least + 1e-5} <= set(got) <= {n for n, s in score.items() if s >= least - 1e-5}


def found_licenses(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: {x["license"] for x in r["licenses"]} for r in licenses.scan(df, **options).collect()}
    return [got[i] for i in range(len(texts))]


def test_licenses(spark, odd, none):
    full = dict((n, t) for n, t in reversed(licenses.TEMPLATES) if len(t) > 200)
    texts = [
        ("Some prose.\nLicensed under CC BY-NC 4.0.\nMore prose.", {"CC-BY-NC-4.0"}),
        ("Licensed under CC BY 4.0.", {"CC-BY-4.0"}),
        ("Released under the MIT License. All rights reserved.", {"MIT", "all-rights-reserved"}),
        ("This work is licensed under the GNU General Public License, version 3.", {"GPL-3.0"}),
        ("This work is licensed under the GNU General Public License, version 2.", {"GPL-2.0"}),
        ("This work is licensed under the GNU General Public License, version 4.", set()),
        ("Licensed under the Apache License 2.0", {"Apache-2.0"}),
        ("It is distributed under the GNU GPL v3, like the rest.", {"GPL-3.0"}),
        ("# SPDX-License-Identifier: LGPL-2.1-or-later\nimport os", {"LGPL-2.1"}),
        ("We license nothing and reserve little.", set()),
        ("We have not released this under the MIT License.", set()),
        ("This is not licensed under CC BY 4.0.", set()),
        ("It was never released under the MIT License, nor licensed under CC BY 4.0.", set()),
        ("It is not ours. Released under the MIT License.", {"MIT"}),
        ("In, of the inanin. Thonst aonthrein thedtiou anon.\nReleased under the MIT License.", {"MIT"}),
        ("prose " * 3000 + full["MIT"] + " prose" * 3000, {"MIT"}),
        (full["BSD-3-Clause"], {"BSD-3-Clause"}),
        (full["BSD-2-Clause"], {"BSD-2-Clause"}),
        (licenses._MIT_WARRANTY, {"MIT"}),
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", {"LGPL-2.1"}),
    ]
    assert found_licenses(spark, [t for t, _ in texts]) == [want for _, want in texts]
    assert licenses.scan(odd).where("size(licenses) > 0").count() == 0 and licenses.scan(none).count() == 0


def test_licenses_whatever_surrounds_them(spark):
    around = "this quite ordinary sentence of prose goes on about other matters for a while and then says that it was"
    texts, want = [], []
    for n, t in licenses.TEMPLATES:
        w = t.split()
        lines_ = [" ".join(w[k : k + 9]) for k in range(0, len(w), 9)]
        texts += [f"{around} {t} {around}.", "// " + "\n// ".join(lines_) + "\n" + "\n".join(f"int value_{i} = compute(other_{i * 7919 % 100}, {i});" for i in range(20))]
        want += [n, n]
    got = found_licenses(spark, texts)
    assert [(n, t) for n, t, g in zip(want, texts, got) if n not in g] == []
    assert sum(g != {n} for n, g in zip(want, got)) == 0


def test_licenses_of_several_thousand_characters(spark):
    rng = random.Random(8)
    long = "This license covers " + " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(1000)) + " and ends."
    w = long.split()
    near = [x if i % 20 else "changed" for i, x in enumerate(w)]
    far = [x if i % 5 else "changed" for i, x in enumerate(w)]
    texts = [long, "start " * 500 + long + " end" * 500, " ".join(near), " ".join(far), " ".join(w[:500])]
    assert len(long) > 5500 and found_licenses(spark, texts, templates=(("Long", long),)) == [{"Long"}, {"Long"}, {"Long"}, set(), set()]


def brute_licenses(scanner, text):
    """Every window of every template's length is compressed with that template and compared by its words: no anchors."""
    placed = licenses.words_of(text)
    words, found = [w for w, _, _ in placed], []
    for k, template in enumerate(scanner.words):
        n, wanted = len(template), set(template)
        slack = int(licenses.SLACK * n) + 2
        hits = [w in wanted for w in words]
        for lo in range(max(1, len(words) - n + 1)):
            if sum(hits[lo : lo + n + 2 * slack]) < 0.9 * n or not hits[lo]:
                continue
            window = words[lo : lo + n + 2 * slack]
            saved = scanner.saved(k, window)
            missing, added, first, last = licenses.differences(template, window)
            if licenses.confirmed(template, missing, added) and not licenses.denied(text, placed, lo + first):
                found.append((-saved, k, lo + first, lo + last, scanner.names[k]))
    out, taken = set(), []
    for _, _, a, b, name in sorted(found):
        if not any(x <= a and b <= y and n != name for x, y, n in taken):
            taken.append((a, b, name))
            out.add(name)
    return out


def test_licenses_match_brute_force(spark, sf):
    """All documents of the small table, and each of them with a notice put into its middle."""
    scanner = licenses.Scanner()
    docs = [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    rng = random.Random(6)
    for t in docs[:60]:
        w = t.split()
        at = rng.randrange(len(w) + 1)
        docs.append(" ".join([*w[:at][-200:], rng.choice(licenses.TEMPLATES)[1], *w[at:][:200]]))
    got = found_licenses(spark, docs)
    assert got == [brute_licenses(scanner, t) for t in docs] and sum(map(bool, got)) > 60


def test_fingerprint_of_results_is_stable(spark, sf):
    """Two runs of a query give the same rows."""
    a, b = (hashlib.sha256(repr(rows(queries.op7_substrings(spark, sf))).encode()).hexdigest() for _ in range(2))
    assert a == b


CLASHES = ("h", "line", "left", "of", "t", "lost", "wordy", "own", "held", "found", "row", "some", "gone", "leaks", "licenses", "__h", "__l", "__left", "__gone", "__url", "host", "path", "bucket", "chunk", "fp", "node")


@pytest.fixture(scope="module")
def clashing(odd):
    return odd.select("doc_id", "text", "lang", "source", *(F.lit(f"mine {c}").alias(c) for c in CLASHES))


@pytest.mark.parametrize("step", ["keep_good", "clean_good", "clean_lines", "decontaminate", "keep_first", "scan", "filter_urls"])
def test_columns_of_any_name_pass_through(spark, clashing, step):
    from lexivane.llm import simhash

    bench = spark.createDataFrame([(1, "nothing of the sort is held by any of these texts")], "item_id long, text string")
    made = {"filter_urls": ("host", "path"), "scan": ("licenses",)}.get(step, ())
    run = {
        "keep_good": lambda d: quality.keep_good(d), "clean_good": lambda d: quality.clean_good(d, limit=0), "clean_lines": lambda d: lines.clean_lines(d, min_sites=1),
        "decontaminate": lambda d: decontaminate.decontaminate(d, bench), "keep_first": simhash.keep_first, "scan": licenses.scan, "filter_urls": lambda d: urls.filter_urls(d, urls.RULES, "text"),
    }[step]
    got = run(clashing)
    kept = [c for c in clashing.columns if c not in made]
    assert set(kept) <= set(got.columns)
    assert all(r[c] == f"mine {c}" for r in got.collect() for c in CLASHES if c not in made)


def test_quality_judges_rows_with_null_and_repeated_ids_one_by_one(spark):
    good = lambda k: "\n".join(" ".join(f"good{k}x{i}y{j}" for j in range(8)) for i in range(8))
    df = spark.createDataFrame([(None, good(1), "h"), (None, "short", "h"), (5, good(2), "h"), (5, "short too", "h"), (6, good(3), "h")], "doc_id long, text string, source string")
    for step in (quality.keep_good, quality.clean_good):
        assert sorted((r["doc_id"] or 0, r["text"]) for r in step(df).collect()) == [(0, good(1)), (5, good(2)), (6, good(3))]
    # Thirty rows of one document hold its lines once for all; thirty documents hold them thirty times.
    copies = spark.createDataFrame([(7, good(4), "h")] * 30, "doc_id long, text string, source string")
    assert quality.judge(copies, limit=20).where("kept").count() == 30
    assert quality.judge(copies.withColumn("doc_id", F.monotonically_increasing_id()), limit=20).where("kept").count() == 1


def test_urls_by_joins_equal_the_trie(spark, sf, monkeypatch):
    rng = random.Random(9)
    label = lambda: rng.choice(["a", "b", "c", "com"])
    made = [(rng.choice(["allow", "block"]), ".".join(label() for _ in range(rng.randint(1, 3))), "/".join(rng.choice(["", "x", "xy", "z"]) for _ in range(rng.randint(1, 3)))) for _ in range(60)]
    made = [(a, h, p if p.startswith("/") or not p else "/" + p) for a, h, p in made] + list(urls.RULES)
    odd_urls = [None, "", "no scheme", "http://", "http://COM", "http://A.com/x", "x://a.b.com/x/z?q", "x://a.b.com", "x://.com/", "x://b..com/xy"]
    odd_urls += [f"x://{'.'.join(label() for _ in range(rng.randint(1, 4)))}/{'/'.join(rng.choice(['x', 'xy', 'xyz', 'z', '']) for _ in range(3))}" for _ in range(300)]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(odd_urls)], "page_id long, url string, row string")
    by_trie = rows(urls.filter_urls(pages, made))
    monkeypatch.setattr(urls, "TRIE_BYTES", 0)
    assert rows(urls.filter_urls(pages, made)) == by_trie
    assert rows(urls.filter_urls(pages, spark.createDataFrame(made, "a string, h string, p string"))) == by_trie
    whole = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    assert rows(urls.filter_urls(whole, urls.RULES).drop("url")) == ask(urls.SQL, sf)


def test_decontamination_of_whole_texts_and_several_indexes(spark, sf):
    """All documents, long ones too, against brute force; and the same items split over many indexes."""
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.createDataFrame(items, "item_id long, text string")
    long = docs.limit(1).select(F.lit(-5).cast("long").alias("doc_id"), F.concat(F.repeat(F.lit("some filler words "), 40_000), F.lit(items[3][1]), F.repeat(F.lit(" more of it"), 40_000)).alias("text"))
    docs = docs.union(long)
    texts = docs.collect()
    want = {(r["doc_id"], i) for r in texts for i in whole_leaks(r["text"], items)}
    assert (-5, items[3][0]) in want and len(want) > 3
    for most in (20_000, 7):
        found = decontaminate.find_leaks(docs, bench, most=most)
        assert found.columns == ["doc_id", "text", "leaks"]
        assert {(r["doc_id"], x["item_id"]) for r in found.collect() for x in r["leaks"]} == want


def whole_leaks(text, items):
    """Items of which a passage holds 0.8 of the five-word shingles, without the index."""
    w = decontaminate.tokens(text)
    width = max(decontaminate.PASSAGE, 2 * max(len(decontaminate.tokens(t)) for _, t in items))
    wanted = {i: {tuple(x[k : k + 5]) for k in range(max(1, len(x) - 4))} for i, t in items if (x := decontaminate.tokens(t))}
    found = set()
    for lo in range(0, max(1, len(w) - width // 2), width // 2):
        have = {tuple(w[k : k + 5]) for k in range(lo, min(lo + width, len(w)) - 4)}
        found |= {i for i, x in wanted.items() if len(x & have) >= 0.8 * len(x)}
    return found


def test_bpe_query_and_other_patterns(spark, sf, tmp_path):
    """The query's digests, and any other pattern, against tiktoken; two vocabularies of one file name."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda b: hashlib.sha256(b).hexdigest()
    ids = {i: enc.encode_ordinary(t) for i, t in docs.items()}
    want = {i: (len(x), digest(" ".join(map(str, x)).encode()), digest(docs[i].encode())) for i, x in ids.items()}
    assert {r["doc_id"]: tuple(r)[1:] for r in queries.op2_bpe(spark, sf).collect()} == want
    rng = random.Random(4)
    texts = ["".join(rng.choice(" \n\tab1.'sé漢😀") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for pattern in (r"\S+|\s+", r"\w+\s?|\W", r"[a-z]+(?= )|[\s\S]", r" ?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s+(?!\S)|\s+"):
        other = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        got = {r["id"]: list(r["ids"]) for r in bpe.encode(df, path, pattern).collect()}
        assert got == {i: other.encode_ordinary(t) for i, t in enumerate(texts)}
    small = tmp_path / "byte_bpe_50k.tiktoken"
    small.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ranks.items() if len(t) == 1))
    assert [len(r["ids"]) for r in bpe.encode(df.where("doc_id < 3"), str(small)).orderBy("id").collect()] == [len(t.encode()) for t in texts[:3]]


def test_language_of_long_texts_and_ties(spark, sf, monkeypatch):
    """Texts cut into many slices cost the same bits; equal trees tie for the first language; counts are whole."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    trees = language_id.learn(docs)
    texts = [r["text"].encode() for r in docs.limit(30).collect()] + [b"", "é".encode() * 3000, b"\0\0abc"]
    whole = trees.code_lengths(texts)
    monkeypatch.setattr(language_id, "SLICE", 1000)
    assert trees.code_lengths(texts) == pytest.approx(whole, rel=1e-12)
    assert trees.code_lengths(texts)[0] == pytest.approx(trees.code_lengths([texts[0]])[0], rel=1e-12)
    same = spark.createDataFrame([(i, "the same words", x) for i in range(40) for x in ("b", "a")], "doc_id long, text string, lang string")
    told = language_id.identify(same, language_id.learn(same)).collect()
    assert {(r["lang_pred"], r["score"]) for r in told} == {("a", 0.5)}
    train = docs.where(~language_id.held_out(F.col("doc_id")) & F.col("lang").isNotNull()).collect()
    for lang, tree in zip(trees.languages, trees.trees):
        seen = set().union(*({(b"\0\0\0" + t)[k : k + 4] for k in range(len(t))} for t in (r["text"].encode().lower() for r in train if r["lang"] == lang)))
        assert len(tree.levels[3][0]) == len(seen)
