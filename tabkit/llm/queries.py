"""The queries of these operators over the given tables, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabkit.llm import bpe, chat, decontaminate, licences, line_rules, lines, pieces, quality, rollups, simhash, structure, vectors, warc
from tabkit.llm.common import shared_folder, stored, table
from tabkit.llm.sql import (
    CHAT_SQL, DECONTAMINATED_SQL, DECONTAMINATION_SQL, LICENCE_SQL, LINES_SQL, PIECES_SQL, ROLLUP_SQL, RULES_SQL, STRUCTURE_SQL, VECTORS_SQL, WARC_SQL,
)

RANKS = "byte_bpe_50k.tiktoken"


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), folder, "page_id", "html", "url")
    read = warc.read_archive(spark, folder)
    return read.select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    index = stored(vectors.build_index(rows, "vec_id", "embedding"), "vector-index")
    asked = rows.filter(F.col("vec_id") % 20 == 0)
    return vectors.search(index, asked, "vec_id", "embedding", k=20)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.annotate(docs, table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"),
        "contaminated",
    )


def decontaminated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts without the words that stand in windows of the benchmark, and what lies between two such words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.annotate(docs, table(spark, sf_dir, "benchmark"))
    cut = F.coalesce(decontaminate.cut_spans(), F.lit(""))
    return found.select("doc_id", F.col("n_hit").alias("n_cut"), F.length(cut).cast("long").alias("kept_chars"), F.sha2(cut, 256).alias("kept_sha256"))


def _tokenizer() -> dict[bytes, int]:
    return bpe.read_ranks(public_tokenizers.path(RANKS))


def _digests() -> list:
    return [
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    ]


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, "text", _tokenizer(), public_tokenizers.PATTERN, bytes_col="decoded").select("doc_id", *_digests())


TARGETS = ["quality", "toxic"]


def _judged(spark: SparkSession, docs: DataFrame, sf_dir: str, keep: list[str]) -> DataFrame:
    """Columns of the documents with both scores and ``keep``: good and not toxic, more likely than not."""
    scored = quality.co_train(docs, table(spark, sf_dir, "labels"), TARGETS, keep=keep)[1]
    return scored.withColumn("keep", (F.col("quality_score") >= 0.5) & (F.col("toxic_score") < 0.5))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, table(spark, sf_dir, "documents"), sf_dir, ["doc_id"])


PROBE = "</s>[INST] ok [/INST]"


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(probe)
    made = chat.windows(turns)
    fresh = F.filter(chat.read_turns(F.col("text")), lambda t: ~t["past"])
    read = made.select(
        "conv_id", "window", F.size(fresh).alias("n"), F.length("text").alias("size"),
        F.array_join(F.transform(fresh, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        chat.read_loss(F.col("text"), F.col("loss")).alias("learnt"),
    )
    whole = F.sort_array(F.collect_list(F.struct("window", "turns", "learnt")))
    joined = read.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("size").alias("formatted_chars"), whole.alias("w"))
    turns_text, learnt = F.array_join(F.transform("w", lambda x: x["turns"]), ""), F.array_join(F.transform("w", lambda x: x["learnt"]), "")
    return joined.select(
        "conv_id", "n_turns", F.sha2(turns_text, 256).alias("turns_sha256"), F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"), "formatted_chars",
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "visited")


WORDS_V1 = r"[^\x20\x09-\x0D]+"
WORDS_V2 = "[0-9]|[A-Za-z]+"


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load all documents, withdraw those labelled as bad, recount by a revised tokenizer; send a batch twice."""
    rollup = rollups.Rollup(spark, shared_folder(spark, "token-counts"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text"))
    bad = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id").distinct()
    v1, v2 = (F.regexp_count("text", F.lit(p)).cast("long") for p in (WORDS_V1, WORDS_V2))
    counts = stored(docs.select("doc_id", "source", "lang", v1.alias("v1"), v2.alias("v2")), "token-counts")
    none = F.lit(None).cast("long")

    def change(rows: DataFrame, kind: str, tokenizer: str, old, new) -> DataFrame:
        return rows.select(F.lit(kind).alias("change"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), old.alias("old_tokens"), new.alias("new_tokens"))

    withdrawn = counts.join(bad, "doc_id", "left_semi")
    kept = counts.join(bad, "doc_id", "left_anti")
    rollup.commit("load", change(counts, "insert", "words", none, F.col("v1")).union(change(counts, "insert", "runs", none, F.col("v1"))))
    rollup.commit("withdraw", change(withdrawn, "delete", "words", F.col("v1"), none).union(change(withdrawn, "delete", "runs", F.col("v1"), none)))
    rollup.commit("recount", change(kept, "revise", "runs", F.col("v1"), F.col("v2")))
    rollup.commit("withdraw", change(withdrawn, "delete", "words", F.col("v1"), none))
    return rollup.totals()


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents laid out as a tree by source and language, one in five as a licence file."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    folder = F.when(F.col("doc_id") % 3 == 0, F.col("source")).when(F.col("doc_id") % 3 == 1, F.concat_ws("/", "source", "lang"))
    deep = F.concat_ws("/", "source", "lang", F.pmod(F.col("doc_id"), F.lit(100)).cast("string"))
    name = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("LICENSE-"), F.col("doc_id"))).otherwise(F.concat(F.col("doc_id"), F.lit(".txt")))
    files = docs.select("doc_id", F.concat_ws("/", F.coalesce(folder, deep), name).alias("path"), "text")
    found = licences.scan(files)
    return found.select("doc_id", "path", "licence", "basis", "from_dir", F.round("cosine", 6).alias("cosine"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = lines.apply_bitmaps(docs, lines.keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = pieces.transform(docs)
    return made.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def _damaged(turns: DataFrame) -> DataFrame:
    """Conversations with rows lost, emptied, cut, repeated and given the wrong role, as the CRC-32 of their place says."""
    space = F.lit(" ")
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    kind, text = F.crc32(name) % 20, F.coalesce("text", space)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(F.col("kind") == 4, "user").otherwise(F.coalesce("role", space))
    rows = turns.withColumn("kind", kind).filter("kind != 0")
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op12_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    made = structure.repair(_damaged(turns))
    reports, hashes = made.reports, structure.digests(made.pieces).withColumnRenamed("conv_id", "d")
    found = reports.join(hashes, reports["conv_id"].eqNullSafe(hashes["d"])).drop("d").withColumnRenamed("conv_id", "c")
    every = turns.select("conv_id").distinct()
    counts = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.sha2(F.lit(b""), 256)
    return every.join(found, every["conv_id"].eqNullSafe(found["c"]), "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"),
    )


def op13_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


CHECKS = {
    "op1_warc": (op1_warc, WARC_SQL),
    "op2_neighbours": (op2_neighbours, VECTORS_SQL),
    "op3_decontaminate": (op3_decontaminate, DECONTAMINATION_SQL),
    "decontaminated_texts": (decontaminated_texts, DECONTAMINATED_SQL),
    "op4_bpe": (op4_bpe, None),
    "op5_quality": (op5_quality, None),
    "op6_chat": (op6_chat, CHAT_SQL),
    "op7_simhash": (op7_simhash, None),
    "op8_token_counts": (op8_token_counts, ROLLUP_SQL),
    "op9_licences": (op9_licences, LICENCE_SQL),
    "op10_lines": (op10_lines, LINES_SQL),
    "op11_pieces": (op11_pieces, PIECES_SQL),
    "op12_structure": (op12_structure, STRUCTURE_SQL),
    "op13_line_rules": (op13_line_rules, RULES_SQL),
}
