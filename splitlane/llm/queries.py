"""The operators as named queries over the given tables, with SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitlane.llm import byte_pairs, oracle
from splitlane.llm.common import table
from splitlane.llm.decontaminate import contamination, hit_words
from splitlane.llm.hilbert import hilbert_shards
from splitlane.llm.licenses import license_scan
from splitlane.llm.near_dup import near_duplicates
from splitlane.llm.packing import packed
from splitlane.llm.periodic_runs import periodic_runs, with_periods
from splitlane.llm.pii import labelled_table, personal_data, train_from
from splitlane.llm.pii_base import KINDS
from splitlane.llm.prefix_trie import paths, prefix_trie, with_shared_heads
from splitlane.llm.repetition import judged, repetition
from splitlane.llm.site_templates import extracted
from splitlane.llm.warc import archived
from splitlane.llm.weak_labels import quality


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def op1_site_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extracted(table(spark, sf_dir, "pages"))
    return found.select(
        "row.page_id", "row.url", "out.text", F.char_length("out.text").cast("long").alias("n_chars")
    )


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = archived(table(spark, sf_dir, "pages"))
    return read.select(
        "page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to"
    )


def op3_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    ties = [F.col("text_crc32"), F.col("doc_id")]
    placed = hilbert_shards(docs, ["lang", "source", "n_chars"], ties)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
        "lang",
        "source",
        "n_chars",
    )


def op4_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "row.doc_id",
        "out.n_words",
        hit_words().alias("n_hit"),
        F.size("out.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "out.items"), 256).alias("items_sha256"),
        (hit_words() > 0).alias("contaminated"),
    )


def op5_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = personal_data(docs, crf=train_from(labelled_table(docs)))
    spans = F.col("out.spans")
    base = F.filter(spans, lambda s: s["base"])

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(which):
        return F.array_join(F.transform(which, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "row.doc_id", *map(count, KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans")
    )


def op6_conditional_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sure = F.filter("out.found", lambda f: f["confirmed"])
    return found.select(
        "row.doc_id",
        "out.n_blocks",
        F.size(sure).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda f: f["license"]))), ",").alias("licenses"),
        F.array_join(
            F.transform(
                "out.found",
                lambda f: F.concat_ws(":", f["license"], f["start"], f["end"], f["differences"], f["confirmed"]),
            ),
            ",",
        ).alias("blocks"),
    )


def op7_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs).select("row.doc_id", "out.n_words", "out.weak", "out.score", "out.kept")


def op8_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op9_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(repetition(docs)).select(
        "row.doc_id",
        "out.n_words",
        "out.word_chars",
        "out.n_symbols",
        "out.n_dup_lines",
        "out.n_repeat_words",
        "base_failed",
        "kept",
        "out.longest_repeat",
    )


def op10_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op11_corpus_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pattern, ranks = public_tokenizers.PATTERN, public_tokenizers.path(byte_pairs.RANKS)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    shared = byte_pairs.lexicon(docs, pattern, ranks)
    found = byte_pairs.encoded(docs, pattern, ranks, shared=shared, back=True)
    return found.select(
        "row.doc_id",
        F.floor(F.octet_length("out.ids") / 4).alias("n_tokens"),
        F.sha2("out.ids", 256).alias("ids_sha256"),
        F.sha2("out.bytes", 256).alias("decoded_sha256"),
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", with_periods(F.col("doc_id"), F.col("text")).alias("text")))
    runs = F.col("out.runs")
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    start, length, period = -best["col2"], best["length"], -best["col3"]
    return found.select(
        "row.doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(length * 1000 / period).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("out.collapsed", 256).alias("collapsed_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    convs = with_shared_heads(paths(turns, "conv_id", "turn", "role", "text"))
    return prefix_trie(convs)


QUERIES = {
    "op1_site_template_text": Query(op1_site_template_text),
    "op2_warc_archive": Query(op2_warc_archive),
    "op3_hilbert_sharding": Query(op3_hilbert_sharding),
    "op4_suffix_decontamination": Query(op4_suffix_decontamination, oracle.DECONTAMINATION),
    "op5_crf_pii": Query(op5_crf_pii),
    "op6_conditional_license_scan": Query(op6_conditional_license_scan),
    "op7_weak_label_quality": Query(op7_weak_label_quality),
    "op8_minhash_near_dup": Query(op8_minhash_near_dup, oracle.NEAR_DUP),
    "op9_suffix_repetition": Query(op9_suffix_repetition),
    "op10_cost_balanced_packing": Query(op10_cost_balanced_packing),
    "op11_corpus_merge_replay": Query(op11_corpus_merge_replay),
    "op12_periodic_runs": Query(op12_periodic_runs),
    "op13_prefix_trie": Query(op13_prefix_trie, oracle.TRIE),
}
