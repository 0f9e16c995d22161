"""The training-data operators against plain versions, on small tables with nulls, ties, repeats and clashes."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tabkit.llm import bpe, chat, components, decontaminate, licences, lines, quality, rollups, simhash, vectors, warc
from tabkit.llm.common import shared_folder

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
LONG = "word " * 30_000


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# WARC

def test_archive_round_trip(spark):
    big = "<p>" + "x" * 200
    rows = [(5, "u5", big), (3, "u3\r\nWARC-Type: revisit", big), (9, None, big), (None, "n", big), (4, "u4", None), (6, "u6", "s"), (7, "u7", "s"), (7, "u7", "s")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    folder = shared_folder(spark, "warc-test")
    warc.write_archive(df, folder, "page_id", "html", "url")
    read = warc.read_archive(spark, folder).withColumn("record", warc.record_bytes()).collect()
    assert len(read) == len(rows) and spark.read.parquet(f"{folder}/payloads").count() == 3
    found = {r["record_id"]: r for r in read}
    assert (found["3"]["record_type"], found["5"]["refers_to"], found["9"]["record_type"]) == ("response", "3", "revisit")
    assert found[None]["refers_to"] == "3" and found["7"]["record_type"] == "response"
    for r in read:
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        size = int(re.search(rb"(?m)^Content-Length: (\d+)", head)[1])
        assert rest[size:] == b"\r\n\r\n" and sha(bytes(r["payload"])) == r["payload_digest"]
        assert (rest[:size].endswith(bytes(r["payload"]))) or r["record_type"] == "revisit"


def test_damaged_payload_fails(spark):
    folder = shared_folder(spark, "warc-test")
    warc.write_archive(spark.createDataFrame([(1, "u", "text")], "i long, u string, h string"), folder, "i", "h", "u")
    bad = spark.read.parquet(f"{folder}/payloads").withColumn("payload", F.lit(b"other"))
    other = shared_folder(spark, "warc-test")
    bad.write.parquet(f"{other}/payloads")
    spark.read.parquet(f"{folder}/headers").write.parquet(f"{other}/headers")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archive(spark, other).select("payload_digest").collect()


# vectors

def brute(ids, x, asked, k):
    out = []
    for q in asked:
        s = x @ x[list(ids).index(q)]
        near = sorted((-v, i) for v, i in zip(s, ids) if i != q)[:k]
        out += [(q, n + 1, i, -v) for n, (v, i) in enumerate(near)]
    return out


@pytest.mark.parametrize("shard", [7, 1000])
def test_exact_search(spark, shard):
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (300, 6)).astype(float)
    x[(x == 0).all(axis=1)] = 1
    x[100:200] = x[100]  # ties
    df = spark.createDataFrame([(i, v.tolist(), i) for i, v in enumerate(x)], "vec_id long, e array<double>, rank long")
    odd = spark.createDataFrame([(900, None, 0), (901, [0.0] * 6, 0), (902, [float("nan")] * 6, 0), (903, [1.0], 0), (5, x[5].tolist(), 0)], df.schema)
    index = vectors.build_index(df.union(odd), "vec_id", "e", shard=shard)
    found = vectors.search(index, df.filter("vec_id % 20 = 0"), "vec_id", "e", k=20, query_block=5).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in found] == brute(range(300), x, range(0, 300, 20), 20)


def test_search_prunes_and_keeps_recall():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 4000)] + 0.02 * rng.normal(size=(4000, 16)))
    x /= np.linalg.norm(x, axis=1)[:, None]
    order, nodes = vectors.grow(vectors.lifted(x, 1.0), 16)
    row = {"ids": order.astype(np.int64).tobytes(), "vectors": x[order].tobytes(), "spread": 1.0, "nodes": nodes.tobytes()}
    asked, exact, visited = np.arange(100), None, []
    for factor in (1.0, 2.0):
        tree = vectors.Tree(row)
        q, v, _ = tree.search(asked, x[:100], 20, factor)
        pairs = set(zip(q.tolist(), v.tolist()))
        exact = exact or pairs
        assert len(pairs & exact) >= 0.9 * len(exact)
        visited.append(tree.visited)
    assert visited[0] < 0.5 * 100 * 4000 and visited[1] <= visited[0]


# decontamination

def plain_decontamination(text, items, size=13):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for item, other in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), other or ""))
        n = min(len(w), size)
        windows = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(words) - n + 1) if n else ():
            if tuple(words[i:i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(words), len(hit), sorted(x for x in found if x is not None), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("block_bytes", [1_000_000, 60])
def test_decontamination(spark, block_bytes):
    rnd = random.Random(3)
    vocabulary = ["a", "b", "C", "é", "d1"]
    make = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, make(rnd.randint(1, 30) if i > 2 else 40)) for i in range(6, 12)] + [(1, "a b a b b a b"), (2, ""), (3, None), (4, "zz"), (4, "yy!"), (5, " ".join("abcdefghijklmnop"))]
    texts = [make(rnd.randint(0, 80)) for _ in range(60)] + [None, "", "x zz x", "YY", "q" * 50 + " " + " ".join("abcdefghijklmnop"), LONG + items[0][1], items[1][1]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    found = decontaminate.annotate(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) for r in found}
    assert got == {i: plain_decontamination(t, items) for i, t in enumerate(texts)}


def test_decontamination_without_items_and_cut(spark):
    docs = spark.createDataFrame([(1, "One, two three! four")], "doc_id long, text string")
    none = decontaminate.annotate(docs, spark.createDataFrame([], "item_id long, text string")).first()
    assert (none["n_words"], none["n_hit"], none["contaminated"]) == (4, 0, False)
    item = spark.createDataFrame([(1, "two THREE")], "item_id long, text string")
    cut = decontaminate.annotate(docs, item).select(decontaminate.cut_spans().alias("t")).first()["t"]
    assert cut == "One, ! four"


def test_cut_counts_words_as_spans_do(spark):
    texts = ["Hello USA World the Big Cat sat", "iPhone USA Two THREE Four", "NASA É two iPHONE three, End", "two Three"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, "World THE big"), (2, "two three"), (3, "iphone Three")], "item_id long, text string")
    cut = decontaminate.annotate(docs, items).withColumn("t", decontaminate.cut_spans()).collect()
    assert {r["doc_id"]: r["t"] for r in cut} == {0: "Hello USA  Cat sat", 1: "iPhone USA  Four", 2: "NASA É two , End", 3: ""}


# byte-level BPE

def test_bpe_equals_the_library_and_returns(spark):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    rnd = random.Random(4)
    pool = [chr(c) for c in [*range(300), 0x3000, 0x2028, 0x180E, 0x1F600, 0x627, 0x4E00, 0x301, 0x200B, 0x2167, 0xB2]] + list("aaaab  \n'sre") * 5
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 60))) for _ in range(500)] + [None, "", "a" * 20_000, LONG, "<|endoftext|>"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, IDS string")
    encoded = bpe.encode(df, "text", RANKS, public_tokenizers.PATTERN)
    for r in bpe.decode(encoded, "ids", RANKS).collect():
        text = texts[r["doc_id"]] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()
    assert bpe.encode(df.limit(0), "text", RANKS, public_tokenizers.PATTERN).count() == 0


# SimHash

def plain_print(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(nodes, linked):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if low[a] != low[b] and linked(a, b):
                    low[a] = low[b] = min(low[a], low[b])
                    changed = True
    return low


def test_fingerprints():
    for text in [None, "", " \n", "One", "one two", "A b\tC d e f É", "x y z " * 50, LONG]:
        assert simhash.fingerprint(text) == plain_print(text)


@pytest.mark.parametrize(("shard", "group", "block"), [(4, 9, 5), (50, 50, 3), (2048, 10**6, 8192)])
def test_links_connect_what_all_pairs_would(spark, shard, group, block):
    rnd = random.Random(5)
    points = set()
    for _ in range(25):
        base = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 14)):
            base ^= sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 3)))
            base &= (1 << 64) - 1
            points.add(base)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    nodes = sorted(signed(p) for p in points)
    classes = spark.createDataFrame([(p,) for p in nodes], "fp long")
    found = simhash.links(classes, shard=shard, group=group, block=block)
    low = {r["node"]: r["low"] for r in components.components(found.filter("b IS NOT NULL"), "a", "b").collect()}
    assert {n: low.get(n, n) for n in nodes} == plain_components(nodes, lambda a, b: ((a ^ b) & simhash.ALL_BITS).bit_count() <= 2)
    trees = -(-len(nodes) // shard)
    visited = found.filter("b IS NULL").groupBy("a").agg(F.count("*").alias("n"), F.sum("visited").alias("v")).collect()
    assert len(visited) == len(nodes) and all(0 < r["v"] <= len(nodes) and r["n"] <= trees for r in visited)


def test_trees_leave_out_what_is_far():
    rng = np.random.default_rng(3)
    points = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * 2 + rng.integers(0, 2, 20_000, dtype=np.uint64))
    near = points[:500] ^ np.uint64(1 << 9) ^ np.uint64(1 << 40)
    every = np.unique(np.concatenate([points, near]))
    found = []
    visited = simhash.walk(simhash.grow(every), near, 2, lambda query, place: found.append((query, place)))
    tree = simhash.grow(every)[0]
    got = {(int(q), int(tree[p])) for query, place in found for q, p in zip(query, place, strict=True)}
    assert {(i, int(points[i])) for i in range(500)} | {(i, int(near[i])) for i in range(500)} <= got
    assert all((int(near[q]) ^ p).bit_count() <= 2 for q, p in got)
    assert visited.mean() < len(every) / 4


def test_crowds_make_few_links():
    base = np.uint64(0x0123456789ABCDEF)
    bits = [np.uint64(1 << i) for i in range(64)]
    crowd = np.unique(np.array([base] + [base ^ a for a in bits] + [base ^ a ^ b for a in bits for b in bits if a < b], np.uint64))
    a, b, _ = simhash.block_links(simhash.grow(crowd), crowd, 2)
    assert len(a) == len(crowd) - 1 and len(set(b.tolist())) == 1
    same = np.array([0], np.uint64)
    assert len(simhash.block_links(simhash.grow(same), same, 2)[0]) == 0
    assert simhash.walk(simhash.grow(same[:0]), crowd[:3], 2, None).tolist() == [0, 0, 0]


def test_whole_query_equals_plain_version(spark):
    from tabkit.llm import queries
    docs = {r["doc_id"]: plain_print(r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    low = plain_components(sorted(set(docs.values())), lambda a, b: (a ^ b).bit_count() <= 2)
    first = {}
    for doc, fp in docs.items():
        first[low[fp]] = min(doc, first.get(low[fp], doc))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op7_simhash(spark, "/root/testdata/sf0.001").collect()}
    assert got == {doc: (f"{fp:016x}", first[low[fp]]) for doc, fp in docs.items()}


def test_near_duplicates(spark):
    rows = [(4, "a b c d"), (2, "a b c d"), (2, "a b c d"), (7, None), (9, ""), (None, "a B c d"), (None, "lonely text here"), (1, LONG)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp long")
    found = simhash.near_duplicates(df)
    got = sorted(((r["doc_id"], r["component_id"]) for r in found.collect()), key=str)
    assert got == sorted([(4, 2), (2, 2), (2, 2), (7, 7), (9, 7), (None, 2), (None, None), (1, 1)], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


# lines

def plain_lines(rows):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and text is not None:
                first[key(line)] = min(first.get(key(line), doc), doc)
    kept = []
    for doc, text in rows:
        parts = (text or "").split("\n")
        stay = [p for p in parts if doc is None or len(key(p)) < 10 or first[key(p)] == doc]
        kept.append((doc, len(parts), len(parts) - len(stay), None if text is None else "\n".join(stay)))
    return sorted(kept, key=str)


@pytest.mark.parametrize("parts", ["1", "9"])
def test_lines(spark, parts):
    rnd = random.Random(6)
    pool = ["common line of text", " Common LINE of text\t", "short", "", "ééééé éééé", "É" * 10, "é" * 10] + [f"unique line {i}" for i in range(40)]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 9)))) for i in range(80)]
    rows += [(3, rows[3][1]), (3, "common line of text\nanother text"), (None, "common line of text"), (200, None), (201, ""), (202, LONG), (203, LONG)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, hash string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = lines.apply_bitmaps(df, lines.keep_bitmaps(df)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in found), key=str) == plain_lines(rows)


# chat

def test_windows(spark):
    rnd = random.Random(7)
    rows = [(c, t, "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2], "w~t <|end|> [INST] " * rnd.randint(0, 30)) for c in range(6) for t in range(rnd.randint(1, 40))]
    rows += [(None, 1, "user", "q"), (None, 2, "assistant", None), (7, 1, None, "x"), (7, 1, "assistant", "x"), (7, 1, "assistant", "x"), (8, 0, "ro\nle<|turn|>", LONG)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, window long")
    made = chat.windows(df, budget=400, history_tokens=100)
    read = made.withColumn("turns", chat.read_turns(F.col("text"))).withColumn("learnt", chat.read_loss(F.col("text"), F.col("loss"))).collect()
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv), key=lambda r: r[0])
        mine = sorted((r for r in read if r["conv_id"] == conv), key=lambda r: r["window"])
        fresh = [(t["role"], t["text"]) for r in mine for t in r["turns"] if not t["past"]]
        assert sorted(fresh) == sorted(x[1:] for x in own) and (conv == 7 or fresh == [x[1:] for x in own])
        assert "".join(r["learnt"] for r in mine) == "".join(text for role, text in fresh if role == "assistant")
        for r in mine:
            past = [t for t in r["turns"] if t["past"]]
            assert len(past) == r["n_past"] <= 3 and (own[0][1] != "system" or r["turns"][0]["role"] == "system")
            tokens = [max(1, -(-len(t["text"].encode()) // 4)) for t in r["turns"]]
            assert sum(tokens) <= 400 or max(tokens) > 50
    assert chat.windows(df.limit(0)).count() == 0


# rollups

def test_rollup(spark):
    rollup = rollups.Rollup(spark, shared_folder(spark, "rollup-test"))
    assert rollup.totals().count() == 0
    changes = lambda *rows: spark.createDataFrame([(*r, 1) for r in rows], "change string, source string, lang string, tokenizer string, old_tokens long, new_tokens long, docs long")
    first = changes(("insert", "s", "en", "v1", None, 5), ("insert", "s", "en", "v1", None, 7), ("insert", None, "de", "v1", None, None))
    assert rollup.commit("a", first) and not rollup.commit("a", first)
    assert rollup.commit("b", changes(("delete", "s", "en", "v1", 5, None), ("revise", "s", "en", "v1", 7, 9)))
    with pytest.raises(Exception, match="unknown change"):
        rollup.commit("c", changes(("add", "s", "en", "v1", 5, None)))
    assert rollup.committed() == ["a", "b"] and rollup.commit("empty", first.limit(0))
    want = {(None, "de", "v1", 1, 0), ("s", "en", "v1", 1, 9)}
    assert {tuple(r) for r in rollup.totals().collect()} == want
    assert rollup.compact() and {tuple(r) for r in rollup.totals().collect()} == want
    assert rollup.commit("d", changes(("delete", None, "de", "v1", 0, None))) and not rollup.commit("b", first)
    assert {tuple(r) for r in rollup.totals().collect()} == {("s", "en", "v1", 1, 9)}


# licences

def test_licences(spark):
    mit, cc = "Released under the MIT License.", "Licensed under CC BY-NC 4.0."
    rows = [
        ("a/LICENSE", mit), ("a/b/x.py", "code"), ("a/b/c/COPYING.txt", cc), ("a/b/c/d/y.py", None), ("a/b/c/d/z.py", f"# {mit}\ncode"),
        ("top.py", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\ncode"),
        (None, mit), (None, "code"), ("e/f.py", LONG), ("a/b/x.py", "code"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "path string, text string, licence int")
    found = licences.scan(df).select("path", "text", "licence", "basis", "from_dir").collect()
    got = sorted(((r["path"], r["licence"], r["basis"], r["from_dir"]) for r in found), key=str)
    assert got == sorted([
        ("a/LICENSE", "MIT", "own", None), ("a/b/x.py", "MIT", "inherited", "a"), ("a/b/x.py", "MIT", "inherited", "a"),
        ("a/b/c/COPYING.txt", "CC-BY-NC-4.0", "own", None), ("a/b/c/d/y.py", "CC-BY-NC-4.0", "inherited", "a/b/c"),
        ("a/b/c/d/z.py", "MIT", "own", None), ("top.py", "GPL-3.0", "own", None), (None, "MIT", "own", None), (None, None, "none", None),
        ("e/f.py", None, "none", None),
    ], key=str)
    assert licences.scan(df.limit(0)).count() == 0


def cosine_by_hand(segment, template, texts):
    held = [set(licences.terms_of(t)) for t in texts]
    weight = lambda t: np.log((1 + len(texts)) / (1 + sum(t in h for h in held))) + 1
    a, b = ({t: x.count(t) * weight(t) for t in x} for x in (licences.terms_of(segment), licences.terms_of(template)))
    return sum(w * b.get(t, 0) for t, w in a.items()) / np.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values()))


@pytest.mark.parametrize("common", [0, licences.COMMON])
@pytest.mark.parametrize("size", [1_000, 10_000])
def test_other_terms_weigh_by_their_own_files(spark, monkeypatch, size, common):
    monkeypatch.setattr(licences, "COMMON", common)
    notice = "This project is released under the MIT License."
    texts = [
        " ".join(["the", *["this is"] * (i % 2), *["under a license"] * (i % 10 == 0), *["project"] * (i % 5 == 0), *["mit"] * (i % 100 == 1), *["released"] * (i % 50 == 2)])
        for i in range(size - 1)
    ] + [notice]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = licences.own_licences(df, "id", "text").filter(F.col("key") == size - 1).collect()
    assert [r["licence"] for r in found] == ["MIT"]
    assert found[0]["cosine"] == pytest.approx(cosine_by_hand(notice, "Released under the MIT License.", texts), abs=1e-8)


def test_telling_terms_lose_no_match():
    idf = {t: 1.0 + (len(t) % 5) for _, text in licences.TEMPLATES for t in licences.terms_of(text)}
    weights = licences.template_weights(licences.TEMPLATES, idf)
    telling = set(licences.telling_terms(weights, idf, 0.8))
    for v in weights:
        assert sum(w * w for t, w in v.items() if t not in telling) < 0.8**2


# quality

def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    train = labels.filter("doc_id % 4 != 0")
    scored = quality.fit(docs, train, ["quality", "toxic"]).score(docs.withColumn("quality_score", F.lit("x")))
    test = scored.join(labels.filter("doc_id % 4 = 0"), "doc_id").toPandas()
    assert len(test) > 500
    assert ((test.quality_score >= 0.5) == (test.quality == 1)).mean() > 0.95
    assert ((test.toxic_score >= 0.5) == (test.toxic == 1)).mean() > 0.93


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "", "s", "en", -5), (2, LONG, "s", "en", 3), (2, LONG, "s", "en", 3)], "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(1, 1), (2, 1), (2, 1), (None, 0), (2, None)], "doc_id long, quality int")
    assert {r["quality_score"] for r in quality.fit(docs, labels, ["quality"]).score(docs).collect()} == {1.0}
    assert {r["quality_score"] for r in quality.fit(docs, labels.limit(0), ["quality"]).score(docs).collect()} == {0.5}
    assert quality.fit(docs.limit(0), labels, ["quality"]).score(docs.limit(0)).count() == 0


# hostile and extreme inputs of the archive and of chat windows

def test_hostile_urls_and_repeated_ids_leave_the_archive_whole(spark):
    big = "<p>" + "y" * 150
    bad = [
        "http://a/ WARC-Refers-To: <urn:record:77>", "http://a/ WARC-Payload-Digest: sha256:" + "0" * 64, "x\r\nWARC-Type: revisit\r\n\r\n",
        "x\x85WARC-Type: revisit", "x \x0b\x0c\x00y", "퟿\U0001F600 %0D%0A", "", " ", None, "WARC-Type: revisit",
    ]
    rows = [(i, url, f"{big}{i}") for i, url in enumerate(bad)] + [(3, "again", f"{big}3"), (3, "other", big), (40, "copy", f"{big}3"), (None, "none", f"{big}3"), (None, "n2", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = shared_folder(spark, "warc-test")
    warc.write_archive(df, folder, "page_id", "html", "url")
    read = warc.read_archive(spark, folder).withColumn("record", warc.record_bytes()).collect()
    assert len(read) == len(rows) and len({r["record_name"] for r in read}) == len(rows)
    names = {r["record_name"]: r for r in read if r["record_name"]}
    for r in read:
        head = bytes(r["header"]).split(b"\r\n\r\n")[0].decode()
        assert sum(line.startswith("WARC-Type") for line in head.splitlines()) == 1
        assert len(head.splitlines()) == len(head.split("\r\n")) and sha(bytes(r["payload"])) == r["payload_digest"]
        if r["record_type"] == "revisit":
            pointed = re.search(r"WARC-Refers-To: <urn:record:(.*)>", head)[1]
            assert names[pointed]["payload_digest"] == r["payload_digest"] and r["refers_to"] == "3"
    assert sorted(str(r["record_id"]) for r in read if r["record_type"] == "revisit") == ["40", "None"]


def test_archive_of_nothing_and_of_a_long_payload_and_text_ids(spark):
    folder = shared_folder(spark, "warc-test")
    warc.write_archive(spark.createDataFrame([], "i long, u string, h string"), folder, "i", "h", "u")
    assert warc.read_archive(spark, folder).count() == 0
    folder = shared_folder(spark, "warc-test")
    rows = [("a.b>\r\nc", "u", "x" * 3_000_000), ("é", "u", "x" * 3_000_000)]
    warc.write_archive(spark.createDataFrame(rows, "i string, u string, h string"), folder, "i", "h", "u")
    found = {r["record_id"]: (r["record_type"], r["payload_bytes"]) for r in warc.read_archive(spark, folder).collect()}
    assert found == {"a.b>\r\nc": ("response", 3_000_000), "é": ("revisit", 3_000_000)}


def test_long_system_turns_do_not_multiply(spark):
    rows = [(1, 0, "system", "s" * 6000)] + [(1, i, "assistant" if i % 2 == 0 else "user", "short text") for i in range(1, 41)]
    made = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sum(len(r["text"]) for r in made) < 2 * sum(len(r[3]) for r in rows) + 30 * len(rows)
    assert sum(r["text"].count("s" * 6000) for r in made) == 1
    later = [r for r in made if r["window"] > 0]
    assert all(len(r["text"]) / 4 < 1024 for r in later)


def test_zero_has_one_sign(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [-0.0, 1.0]), (2, [3.0, 3.0])], "vec_id long, e array<double>")
    index = vectors.build_index(df, "vec_id", "e")
    found = vectors.search(index, df.filter("vec_id = 0"), "vec_id", "e", k=20).collect()
    assert [(r["vec_id"], r["score"]) for r in found] == [(2, 3.0), (1, 0.0)]


def test_common_words_beside_a_notice_count_alike_at_every_size(spark):
    for n in (60, 600):
        rows = [(i, "src/a.py" if i else "LICENSE", "plain words of project files " + str(i)) for i in range(n)] + [(n, "lib/LICENSE", "This project is released under the MIT License.")]
        found = licences.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).filter(f"doc_id = {n}").first()
        assert (found["licence"], found["basis"]) == ("MIT", "own") and 0.8 < found["cosine"] < 1


def test_two_licences_of_equal_cosine_and_a_crowded_directory(spark, monkeypatch):
    monkeypatch.setattr(licences, "BROADCAST_DIRS", -1)
    both = "Licensed under CC BY 4.0.\nThis work is licensed under a Creative Commons Attribution 4.0 International License."
    rows = [(1, "a/LICENSE", both)] + [(10 + i, "a/f.txt", f"text {i}") for i in range(300)] + [(2, None, "x"), (3, "b/c/x.txt", None)]
    found = licences.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()
    assert len(found) == len(rows) and {r["licence"] for r in found if r["path"] == "a/f.txt"} == {"CC-BY-4.0"}
    assert {(r["doc_id"], r["basis"]) for r in found if r["doc_id"] in (2, 3)} == {(2, "none"), (3, "none")}


def test_lines_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lines.apply_bitmaps(empty, lines.keep_bitmaps(empty)).count() == 0


def test_two_writers_of_one_batch_count_once(spark):
    folder = shared_folder(spark, "rollup")
    changes = spark.createDataFrame([("insert", "s", "en", "v", None, 5)], "change string, source string, lang string, tokenizer string, old_tokens long, new_tokens long")
    a, b = rollups.Rollup(spark, folder), rollups.Rollup(spark, folder)
    marks = []
    late = b._mark
    b._mark = lambda batch, name: marks.append((batch, name)) or True  # the second writer is held up before its commit
    assert b.commit("one", changes) and a.commit("one", changes) and not a.commit("one", changes)
    assert [late(*m) for m in marks] == [False]
    assert [(r["docs"], r["tokens"]) for r in a.totals().collect()] == [(1, 5)]
    # both get past the look: the later name stands, and the batch still counts once
    names = [f"data/{n}" for n in ("x", "y")]
    for name in names:
        spark.createDataFrame([("s", "en", "v", 1, 7, None, "two")], rollups.SCHEMA).write.parquet(f"{folder}/{name}")
        stream = a._files().create(a._path("commits/two"), True)
        stream.writeBytes(name)
        stream.close()
    assert [(r["docs"], r["tokens"]) for r in b.totals().collect()] == [(2, 12)]
    a._files().create(a._path("commits/three"), True).close()  # a writer died between opening and naming
    assert "three" not in a.committed() and a.commit("three", changes) and a.totals().first()["docs"] == 3
    assert a.compact() and a.totals().first()["tokens"] == 17
    assert "InMemoryFileIndex" not in (plan := a.totals()._jdf.queryExecution().executedPlan().toString()) or plan.count("Scan parquet") == 1


def test_counts_of_a_real_tokenizer_roll_up(spark):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source", "lang", "text")
    coded = bpe.encode(docs, "text", RANKS, public_tokenizers.PATTERN)
    count = (F.octet_length("ids") / 4).cast("long")
    none = F.lit(None).cast("long")
    rows = coded.select(F.lit("insert").alias("change"), "source", "lang", F.lit("byte_bpe_50k").alias("tokenizer"), none.alias("old_tokens"), count.alias("new_tokens"))
    rollup = rollups.Rollup(spark, shared_folder(spark, "rollup"))
    assert rollup.commit("load", rows)
    expected = {}
    for r in docs.collect():
        key = (r["source"], r["lang"])
        n, total = expected.get(key, (0, 0))
        expected[key] = (n + 1, total + len(library.encode_ordinary(r["text"] or "")))
    assert {(r["source"], r["lang"]): (r["docs"], r["tokens"]) for r in rollup.totals().collect()} == expected


def test_blocks_of_items_and_of_queries_do_not_grow_the_plan(spark):
    rnd = random.Random(3)
    items = [(i, " ".join(rnd.choice("abcdefgh") + str(rnd.randrange(30)) for _ in range(30))) for i in range(24)]
    docs = [(i, f"start {items[i % 24][1]} middle {items[(i * 7) % 24][1][:60]} end") for i in range(40)] + [(90, None), (91, "short")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    size = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("\n")
    one, few, many = (decontaminate.annotate(d, b, block_bytes=n) for n in (10**6, 1500, 150))
    assert size(few) == size(many)
    rows = [sorted(tuple(map(str, r)) for r in x.select(*sorted(x.columns)).collect()) for x in (one, few, many)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 42
    assert decontaminate.annotate(d.limit(0), b, block_bytes=150).count() == 0
    rng = np.random.default_rng(2)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(200, 4)))], "vec_id long, e array<double>")
    index = vectors.build_index(v, "vec_id", "e", shard=20)
    found = [vectors.search(index, v, "vec_id", "e", k=3, query_block=n) for n in (5, 1000)]
    assert size(found[0]) == size(found[1]) and sorted(map(tuple, found[0].collect())) == sorted(map(tuple, found[1].collect()))
    assert vectors.search(vectors.build_index(v.limit(0), "vec_id", "e"), v, "vec_id", "e", k=3).count() == 0
    assert vectors.search(index, v.limit(0), "vec_id", "e", k=3).count() == 0


def test_cut_spans_leaves_the_rest_of_a_text(spark):
    item = " ".join(f"Word{i}" for i in range(13))
    docs = spark.createDataFrame([(1, f"Before THE test, {item.upper()}. After it!"), (2, "nothing here"), (3, None)], "doc_id long, text string")
    found = decontaminate.annotate(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    cut = {r["doc_id"]: r["t"] for r in found.select("doc_id", decontaminate.cut_spans().alias("t")).collect()}
    assert cut == {1: "Before THE test, . After it!", 2: "nothing here", 3: None}


def test_repeated_rows_are_encoded_alike(spark):
    texts = ["same text", "same text", None, "", None, "x" * 40_000, "x" * 40_000, "é \U0001F600"]
    df = spark.createDataFrame([(i % 2, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, IDS string")
    found = bpe.encode(df, "text", RANKS, public_tokenizers.PATTERN, bytes_col="decoded").collect()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    assert len(found) == len(texts)
    for r in found:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert ids == library.encode_ordinary(r["text"] or "") and bytes(r["decoded"]).decode() == (r["text"] or "")
    assert bpe.encode(df.limit(0), "text", RANKS, public_tokenizers.PATTERN).count() == 0
