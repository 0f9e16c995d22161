"""Fill-in-the-middle against a plain version that copies texts about."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F
from tabkit.llm import pieces

TEXTS = [
    "", None, "one line", "a\nb\nc", "a\n\n\nb\n", "\n", "\n\n\n", "é€😀\nzwei\r\ndrei\n", "has <P> in it\nand more", "<S", "x<M>", "<P\n>S>\n<\nM>",
    "word " * 200_000 + "\n" + "more\n" * 10_000, " \n \t\n", "a\x0bb c\n\u0085d",
]
ROWS = [(i, text) for i, text in enumerate(TEXTS * 3)] + [(None, "no\nid\nhere"), (3, "a\nb\nc"), (3, "other\ntext")]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(doc, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    mark = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(mark[i:i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (40, 100), (0, 0)])
def test_equals_plain_version(spark, rate, spm):
    df = spark.createDataFrame([(*r, "kept", "clash") for r in ROWS], "doc_id long, text string, extra string, FORM string")
    made = pieces.transform(df, rate=rate, suffix_first=spm)
    found = made.withColumn("output", pieces.rendered(F.col("text"), F.col("pieces"))).withColumn("back", pieces.restore(F.col("output"), F.col("form"))).collect()
    assert len(found) == len(ROWS) and made.columns.count("form") == 1
    expected = sorted((str(doc), sha(text or ""), *plain(doc, text, rate, spm)[:4], sha(plain(doc, text, rate, spm)[4])) for doc, text in ROWS)
    got = sorted((str(r["doc_id"]), r["restored_sha256"], r["n_units"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"]) for r in found)
    assert sorted(map(str, got)) == sorted(map(str, expected))
    for r in found:
        assert sha(r["output"]) == r["output_sha256"] and r["back"] == (r["text"] or "") and r["extra"] == "kept"
        assert {p["buffer"] for p in r["pieces"]} <= {0, 1}
        assert sum(p["size"] for p in r["pieces"] if p["buffer"] == 0) == len((r["text"] or "").encode())


def test_cutting_splits_descriptors_only():
    whole = [(0, 0, 10)]
    for at in range(11):
        before, after = pieces.cut(whole, at)
        assert sum(p[2] for p in before) == at and sum(p[2] for p in after) == 10 - at
    text = b"0123456789"
    head, tail = pieces.cut(pieces.cut(whole, 7)[0], 3)
    made = pieces.arranged([head, tail, pieces.cut(whole, 7)[1]], "spm")
    output = b"".join(pieces.streamed(made, text))
    assert output == b"<S>789<P>012<M>3456"
    assert b"".join(pieces.streamed(pieces.restored(output, "spm"), output)) == text


def test_empty_table(spark):
    assert pieces.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0
