"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.llm import (
    hard_negatives, language, mixing, multi_index, ranked_search, secret_scan, sentence_pieces, simhash, suffix_dedup, token_files, url_filter,
)
from marketlake.llm.common import table
from marketlake.llm.exact_dedup import duplicate_groups
from marketlake.llm.sharding import shard_documents
from marketlake.session import scratch_path, staged

#: Parts per source; sources not named share the rest.
TARGET_PARTS = {"src0": 12, "src1": 8, "src2": 8} | {f"src{i}": 4 for i in range(3, 20)}
REST_PARTS = 4
BLOCK_ROWS = 64

#: (verdict, host/path)
URL_RULES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
]
#: Blocked where no rule decides. Canonical form: a dot, the host, END, the path.
URL_GLOBS = [
    f"*spam*{url_filter.END}**", f"*.casino*{url_filter.END}**", f"*.xxx{url_filter.END}**", f"*{url_filter.END}**/wp-login.php**",
    f"*{url_filter.END}**/cart/**", f"*{url_filter.END}**.exe", f"*.ads?.*{url_filter.END}**", f"*.tracker*.*{url_filter.END}/pixel**",
]


def piece_model() -> str:
    """The installed vocabulary file; another path may be given to the operator."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_tokenizer() -> str:
    """The content of the installed byte-level tokenizer file; that of another path may be given to the operator."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return file.read()


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), 40)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(table(spark, sf_dir, "documents"), text_sha256=F.sha2("text", 256))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, TARGET_PARTS, rest=REST_PARTS, block_rows=BLOCK_ROWS)


def op5_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secret_scan.as_text(F.col("base")), 256).alias("base_sha256"),
        secret_scan.as_text(F.array_sort(F.concat("base", "extra"))).alias("spans"),
    )


def op7_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = sentence_pieces.load_pieces(piece_model())
    return sentence_pieces.encode(docs, pieces, back="again").select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.col("ids").alias("token_ids"), F.sha2("again", 256).alias("decoded_sha256"),
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.withColumn("spans", spans)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = language.learn(language.training_rows(docs))
    found = language.identify(docs, prototypes)
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES, URL_GLOBS)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=moved)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_ids(table(spark, sf_dir, "documents"), path, byte_tokenizer())
    found = staged(token_files.read_ids(spark, path, with_ids=False), "token-rows")
    return token_files.with_starts(found).select("doc_id", "start", "n_tokens", "ids_crc32")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_sharding, op2_exact_dedup, op3_simhash, op4_mixing, op5_multi_index, op6_secrets, op7_sentence_pieces,
    op8_suffix_dedup, op9_language, op10_url_filter, op11_ranked_search, op12_hard_negatives, op13_token_files, pipeline,
)}
