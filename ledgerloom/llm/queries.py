"""The registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, collocations, decontaminate, language_id, lattice, line_dedup, merkle, piece_bpe, sharding, simhash, substring_dedup, voronoi_knn, warc
from .common import table


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi_knn.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


#: A conversation whose texts look like the control strings of common templates.
TRAP = r"\### Assistant: </turn> ok"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    roles = F.explode(F.array(F.lit("user"), F.lit("assistant")))
    trap = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), roles.alias("role"), F.lit(TRAP).alias("text"))
    trap = trap.select("conv_id", (F.col("role") == "assistant").cast("int").cast("long").alias("turn"), "role", "text")
    messages = rows.unionByName(trap).select("conv_id", "turn", "role", chat_format.text_part(F.col("text")).alias("parts"))
    return chat_format.digests(chat_format.read_back(chat_format.format_chats(messages)))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op5_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_bpe.encode_documents(docs, piece_model(), with_ids=False)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs.select("doc_id", "text"), language_id.fit_unheld(docs))
    return found.select("doc_id", (language_id.fold("doc_id") == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link(table(spark, sf_dir, "documents"))


def op9_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"), sharding.Tree.even(24))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.report(table(spark, sf_dir, "documents"))


def op13_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.report(table(spark, sf_dir, "documents"), piece_model())


QUERIES = {
    "op1_voronoi_knn": op1_voronoi_knn,
    "op2_chat_format": op2_chat_format,
    "op3_warc": op3_warc,
    "op4_line_dedup": op4_line_dedup,
    "op5_piece_bpe": op5_piece_bpe,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_language_id": op7_language_id,
    "op8_simhash": op8_simhash,
    "op9_hash_tree": op9_hash_tree,
    "op10_decontaminate": op10_decontaminate,
    "op11_merkle": op11_merkle,
    "op12_collocations": op12_collocations,
    "op13_lattice": op13_lattice,
}
