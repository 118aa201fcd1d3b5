"""The training-data queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import (
    chat_format,
    common,
    decontamination,
    line_crf,
    line_dedup,
    packing,
    pseudonyms,
    quality_qda,
    simhash,
    toxicity,
    url_reputation,
)


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict; the outcome of a page is the quality label of the same number."""
    outcomes = common.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return url_reputation.judge(common.table(spark, sf_dir, "pages"), outcomes)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.duplicates(common.table(spark, sf_dir, "documents"))


def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents")
    field = line_crf.fit(documents, common.table(spark, sf_dir, "labels"))
    return line_crf.label_lines(documents, field)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def packed(documents: DataFrame) -> DataFrame:
    """The packing of ``documents``, with a checksum in place of the ids."""
    pieces = packing.token_pieces(documents, tokenizer_path())
    rows = common.materialize(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "place"))
    return packing.pack(rows, rows.count())


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(common.table(spark, sf_dir, "documents"))


#: The query's key is public; a real run passes its own.
DEMONSTRATION_KEY = b"demonstration key"


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.replace_personal_data(common.table(spark, sf_dir, "documents"), DEMONSTRATION_KEY)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents")
    scored = toxicity.score_all(documents, common.table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id",
        (common.fold(F.col("doc_id")) == 1).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        "evidence",
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.hits(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    hit = decontamination.covered(F.col("spans"))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op8_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents")
    model = quality_qda.fit(documents, common.table(spark, sf_dir, "labels"))
    scored = quality_qda.score(documents, model)
    return scored.select(
        "doc_id",
        (common.fold(F.col("doc_id")) == 1).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.5).cast("int").alias("predicted"),
    )


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.read_back(chat_format.format_conversations(turns.unionByName(chat_format.probe(spark))))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup(common.table(spark, sf_dir, "documents"))
    return done.select("doc_id", "text", "deleted_spans", "copied_from")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_reputation": op1_url_reputation,
        "op2_simhash": op2_simhash,
        "op3_line_crf": op3_line_crf,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_pseudonyms": op5_pseudonyms,
        "op6_toxicity": op6_toxicity,
        "op7_decontamination": op7_decontamination,
        "op8_quality_qda": op8_quality_qda,
        "op9_chat_format": op9_chat_format,
        "op10_line_dedup": op10_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    from tracelake.llm import oracles

    return {"op1_url_reputation": oracles.OP1, "op7_decontamination": oracles.OP7, "op9_chat_format": oracles.OP9}
