"""Quality rules against plain counting."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tabkit.llm import line_rules
from tabkit.llm.common import met, stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def key_of(line):
    return "".join("0" if c in "0123456789" else c.lower() if c.isascii() else c for c in " ".join(WORD.findall(line)))


def base(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times, inside, seen, twice = Counter(grams), set(), set(), 0
    for i, gram in enumerate(grams):
        if times[gram] > 1:
            inside |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if WORD.search(line):
            twice += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), twice, len(inside)


def plain(rows, max_docs, max_share, min_words):
    held, texts = defaultdict(set), defaultdict(set)
    for _, host, text in rows:
        if WORD.search(text or ""):
            texts[host].add(text)
        for line in (text or "").split("\n"):
            if key_of(line):
                held[host, key_of(line)].add(text)
    above = {k for k, docs in held.items() if len(docs) > max_docs and len(docs) > max_share * len(texts[k[0]])}
    out = []
    for doc, host, text in rows:
        n, *rest = base(text)
        gone = sum(len(WORD.findall(line)) for line in (text or "").split("\n") if (host, key_of(line)) in above)
        failed = n < min_words or 2 * rest[-1] > n
        depleted = gone > 0 and (2 * gone > n or n - gone < min_words)
        kept = "\n".join(line for line in (text or "").split("\n") if (host, key_of(line)) not in above) if text is not None else None
        out.append((doc, host, n, *rest, gone, failed, not failed and not depleted, kept if not failed and not depleted else None))
    return sorted(out, key=str)


def documents():
    rnd = random.Random(2)
    prose = lambda n: " ".join(rnd.choice(["ab", "cd", "ef", "gh", "É", "x1", "#", "<b>"]) + str(rnd.randrange(99)) for _ in range(n))
    rows = []
    for i in range(120):
        host = rnd.choice(["hot", "hot", "small", None])
        lines = [prose(rnd.randint(1, 9)) for _ in range(rnd.randint(0, 4))]
        if rnd.random() < 0.6:
            lines.insert(rnd.randrange(len(lines) + 1), f"  Page {rnd.randrange(9)}\tof the MENU ")
        if rnd.random() < 0.2:
            lines += ["Subscribe now and read more of this and that"] * rnd.randint(1, 3)
        rows.append((i, host, "\n".join(lines)))
    rows += [(200, "hot", None), (201, "hot", ""), (None, "hot", "no id here"), (5, "small", rows[5][2]), (300, "hot", "w " * 400_000), (301, "hot", " \n\t")]
    return rows + [(400 + i, "hot", rows[7][2]) for i in range(20)]


@pytest.mark.parametrize(("limits", "broadcast"), [((3, 0.05, 5), 10**6), ((3, 0.05, 5), -1), ((0, 0.0, 1), -1), ((10, 0.01, 50), 10**6)])
def test_equals_plain_counting(spark, limits, broadcast):
    rows = documents()
    max_docs, max_share, min_words = limits
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, kept int")
    judged = line_rules.judge(df, max_docs=max_docs, max_share=max_share, min_words=min_words, broadcast_rows=broadcast)
    names = ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "base_failed", "kept"]
    expected = plain(rows, max_docs, max_share, min_words)
    assert sorted((tuple(r[n] for n in names) for r in judged.collect()), key=str) == sorted((e[:-1] for e in expected), key=str)
    clean = line_rules.cleaned(df, judged)
    assert clean.columns == df.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in clean.collect()) == sorted((str(e[0]), e[-1]) for e in expected if e[-2])


def test_wide_vocabularies_are_counted_exactly():
    words = [f"w{i}".encode() for i in range(300)] * 2
    assert line_rules.repeated_words(words, 3) == 600
    assert line_rules.repeated_words(words, 12) == 600  # 300**12 is beyond a long
    assert line_rules.repeated_words([b"a", b"b", b"c"]) == 0 == line_rules.repeated_words([])


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    judged = line_rules.judge(empty)
    assert judged.count() == 0 and line_rules.cleaned(empty, judged).count() == 0


def test_copies_do_not_make_boilerplate(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(i, "h", text) for i in range(50)] + [(100 + i, "h", text + f"\nown line {i} of a page") for i in range(12)]
    df = spark.createDataFrame(rows[:50], "doc_id long, source string, text string")
    assert line_rules.judge(df).filter("kept").count() == 50
    mixed = line_rules.judge(spark.createDataFrame(rows, df.schema))
    assert mixed.filter("kept").count() == 0 and mixed.filter(F.size("removed") > 0).count() == 62


def test_rows_under_every_salt_are_not_broadcast(spark):
    """Stored files are small, their rows under sixteen salts are not: Spark must not choose by the files."""
    many = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("key"))
    few = stored(spark.range(5).select(F.col("id").alias("key"), F.lit("x").alias("mark")), "few")
    joined = met(many, few, ["key"], "left", broadcast_rows=2)
    assert "BroadcastExchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 1000 and joined.filter("mark = 'x'").count() == many.filter("key < 5").count()
