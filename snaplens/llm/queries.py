"""One query per operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snaplens.llm.ann import nearest
from snaplens.llm.bpe import bpe_encode
from snaplens.llm.common import SPACES, remainder, saved
from snaplens.llm.embedding_dedup import cosine_components
from snaplens.llm.jaccard import jaccard_components
from snaplens.llm.langid import fit, identify
from snaplens.llm.line_templates import LINE_DEDUP_SQL, line_dedup
from snaplens.llm.lm import lm_scores
from snaplens.llm.mixing import plan_mix
from snaplens.llm.periodic import periodic_runs
from snaplens.llm.prefix_trie import ordered_turns, prefix_trie, with_heads
from snaplens.llm.repeats import remove_repeats
from snaplens.llm.sharding import shard_by_size
from snaplens.llm.token_files import read_tokens, write_tokens

TOKENIZER = "word_bpe_49k.json"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/embeddings.parquet")


def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    files = write_tokens(docs, public_tokenizers.path(TOKENIZER), end_id=2)

    return read_tokens(files, docs).select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op2_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(documents(spark, folder), words_each=3, percent=90)


def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    coded = bpe_encode(docs, public_tokenizers.path(TOKENIZER), decode=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(embeddings(spark, folder), F.col("vec_id") % 20 == 0, k=20)


def op5_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return cosine_components(embeddings(spark, folder), cosine=0.95)


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    plan = plan_mix(documents(spark, folder))
    return plan.sizes.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"),
        F.col("mixed.mix_shard").alias("mix_shard"), F.col("mixed.mix_order").alias("mix_order"))


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = shard_by_size(documents(spark, folder), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = fit(docs, remainder("doc_id", 5) != 0)
    held_out = (remainder("doc_id", 5) == 0).alias("held_out")
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out, "lang_pred", "score", "rejected")


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = line_dedup(documents(spark, folder).select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("text_md5"))


def op10_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    scored = lm_scores(docs, remainder("doc_id", 10) != 0)
    return scored.select("doc_id", (remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    own = saved(ordered_turns(spark.read.parquet(f"{folder}/conversations.parquet")), "turns")
    conv = F.col("conv_id")
    return prefix_trie(with_heads(own, conv - conv % 5, F.crc32(conv.cast("string")) % 9))


def looped(doc_id: Column, text: Column) -> Column:
    """The text, where crc32(doc_id) is divisible by ten, with its words from the a-th on repeated every p words.

    A null id has no crc32; its text stays.
    """
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, f"{SPACES}+"), lambda w: w != "")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (F.floor((n - a) / (g % 8 + 3)) + 1).cast("int")
    turns = F.ceil((n - a) / p).cast("int")
    cycle = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), turns)), 1, n - a)
    changed = F.array_join(F.concat(F.slice(words, 1, a), cycle), " ")
    return F.when((h % 10 == 0) & (n > 0), changed).otherwise(text)


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    found = periodic_runs(docs.select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text")), shortest=12)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("length"), r.start.alias("start"), r.period.alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.start").alias("start"),
        (-F.col("longest.length")).alias("length"),
        F.col("longest.period").alias("period"),
        F.floor(-F.col("longest.length") * 1000 / F.col("longest.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = remove_repeats(documents(spark, folder).select("doc_id", "text"), length=100)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r.length)
    return cleaned.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_token_files, op2_jaccard_join, op3_bpe, op4_nearest, op5_embedding_dedup, op6_mixing, op7_sharding,
    op8_language_id, op9_line_dedup, op10_lm_scoring, op11_prefix_trie, op12_periodic_runs, op13_suffix_dedup,
)}
ORACLES = {"op9_line_dedup": LINE_DEDUP_SQL}
