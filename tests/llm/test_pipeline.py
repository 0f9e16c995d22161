"""The pipeline's stages against plain rules on the smallest tables."""

import hashlib
import os
import random
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import tiktoken
from tabkit.llm import simhash
from tabkit.session import ensure_checkpoint_dir
from test_operators import RANKS, plain_components, plain_decontamination, plain_lines, plain_print

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_their_promises(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, empty, SMALL).count() == 0
    rows = [(1, "same text of a few words", "en", "s", 24), (2, "same text of a few words", "en", "s", 24), (2, None, None, None, None), (None, "x y", "en", "s", 3)]
    odd = spark.createDataFrame(rows, docs.schema)
    kept = {(r["doc_id"], r["text"]) for r in corpus_pipeline.simhash_stage(spark, odd, SMALL).collect()}
    assert (1, "same text of a few words") in kept and (None, "x y") in kept and len(kept) == 3
    thinned = {(r["doc_id"], r["text"], r["n_chars"]) for r in corpus_pipeline.lines_stage(spark, odd, SMALL).collect()}
    assert thinned == {(1, rows[0][1], 24), (2, "", 0), (2, None, None), (None, "x y", 3)}


def test_simhash_keeps_one_row_of_each_group(spark):
    rnd = random.Random(7)
    a, b, c, d = (" ".join(f"w{rnd.randrange(10**6)}" for _ in range(400)) for _ in range(4))
    near = next(t for t in (f"{d} z{i}" for i in range(10_000)) if 1 <= (simhash.fingerprint(t) ^ simhash.fingerprint(d)).bit_count() <= 2)
    texts = [(1, a), (2, a), (2, b), (5, c), (5, "other words alone here"), (None, d), (None, near), (None, d), (None, a)]
    schema = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], schema)
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.simhash_stage(spark, docs, SMALL).collect()]
    nameless = [t for i, t in kept if i is None]
    assert len(nameless) == 1 and nameless[0] in (d, near)
    assert sorted(k for k in kept if k[0] is not None) == sorted([(1, a), (2, b), (5, c), (5, "other words alone here")])


def test_run(spark):
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, SMALL)
    found = out.toPandas()
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and left.pop().startswith("byte-level-BPE")
    source = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert 0 < len(found) < source and found["round_trip"].all() and found["doc_id"].is_unique


def test_run_equals_plain_stages(spark):
    docs, items = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "benchmark"))
    judged = [(r["doc_id"], r["text"]) for r in corpus_pipeline.quality_stage(spark, docs, SMALL).collect()]
    thinned = {doc: text for doc, _, _, text in plain_lines(judged)}
    prints = {doc: plain_print(text) for doc, text in thinned.items()}
    low = plain_components(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 2)
    first = {}
    for doc in sorted(thinned):
        first.setdefault(low[prints[doc]], doc)
    rows = [(r["item_id"], r["text"]) for r in items.collect()]
    clean = [doc for doc in first.values() if not plain_decontamination(thinned[doc], rows)[3]]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    digest = lambda text: hashlib.sha256(np.array(library.encode_ordinary(text or ""), "<i4").tobytes()).hexdigest()
    got = {(r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert len(clean) < len(first) < len(thinned)
    assert got == {(doc, digest(thinned[doc])) for doc in clean}


def test_quality_stage_on_odd_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert corpus_pipeline.quality_stage(spark, docs.limit(0), SMALL).count() == 0
    rows = [(1, "same text of a few words", "en", "s", 24), (1, "same text of a few words", "en", "s", 24), (2, None, None, None, None), (None, "", "en", "s", 0)]
    odd = spark.createDataFrame(rows, docs.schema)
    kept = Counter(map(tuple, corpus_pipeline.quality_stage(spark, odd, SMALL).collect()))
    assert all(n in (0, Counter(rows)[row]) for row, n in kept.items()) and set(kept) <= set(rows)
