"""The registered query of each operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoframe.llm import bpe, chat
from lithoframe.llm.exact_dedup import exact_dedup
from lithoframe.llm.labelled import fold_of
from lithoframe.llm.media import image_copies, rendered
from lithoframe.llm.packing import pack_documents
from lithoframe.llm.quality import score_quality, train_quality
from lithoframe.llm.simhash import fingerprint_hex, simhash_groups
from lithoframe.llm.suffix_dedup import removed_spans
from lithoframe.llm.token_file import read_tokens, write_tokens
from lithoframe.llm.toxicity import score_toxicity, train_toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = score_quality(documents, train_quality(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), tokenizer()))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.bpe_digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn int, role string, text string")
    return chat.chat_digests(chat.format_chats(turns.unionByName(own)))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer(), with_ids=False)


def op6_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds images, so each embedding is drawn as one."""
    return image_copies(rendered(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = score_toxicity(documents, train_toxicity(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = removed_spans(table(spark, sf_dir, "documents"), kept="sha256")
    removed = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return spans.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.col("kept").alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_token_file, op3_bpe, op4_chat, op5_best_fit_packing, op6_image_copies, op7_exact_dedup, op8_toxicity, op9_simhash, op10_suffix_dedup)}

ORACLES = {
    "op4_chat": chat.ORACLE,
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
