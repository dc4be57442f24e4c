"""One query for each operator over its whole table, and the check SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfrank.llm import alignment, ann, brown, chat, checks, decontaminate, jaccard, lang_id, orc_ids, pieces, sharding, spelling, toxicity, warc
from shelfrank.llm.storage import table

SHARDS, NEIGHBOURS, QUERY_EVERY = 24, 20, 20


def op1_language(spark: SparkSession, d: str) -> DataFrame:
    docs, held = table(spark, d, "documents"), lang_id.fold("doc_id", 4) == 2
    model = lang_id.fit(docs.where(~held))
    return lang_id.identify(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")


def op2_rendezvous(spark: SparkSession, d: str) -> DataFrame:
    rows = sharding.shard_table(table(spark, d, "documents"), sharding.even(SHARDS), grown=sharding.even(SHARDS + 1))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op3_warc(spark: SparkSession, d: str) -> DataFrame:
    rows = warc.read_warc(spark, warc.write_warc(table(spark, d, "pages")), payloads=False)
    return rows.select(F.col("page_id").cast("long"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long"))


def op4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    index = ann.Index(table(spark, d, "embeddings"))
    return index.search(index.rows.where(F.col("vec_id") % QUERY_EVERY == 0), NEIGHBOURS)


def op5_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.digest(decontaminate.decontaminate(table(spark, d, "documents"), table(spark, d, "benchmark")))


def op6_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return jaccard.groups(table(spark, d, "documents"), size=3, percent=90)


def op7_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    return pieces.digest(table(spark, d, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_brown(spark: SparkSession, d: str) -> DataFrame:
    rows = brown.score(table(spark, d, "documents"), lang_id.fold("doc_id", 5) != 1)
    return rows.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs, held = table(spark, d, "documents"), lang_id.fold("doc_id", 3) == 1
    model = toxicity.fit(docs.where(~held), table(spark, d, "labels"))
    return toxicity.score(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text", "passages")


def op10_orc_ids(spark: SparkSession, d: str) -> DataFrame:
    folder = orc_ids.write_ids(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return orc_ids.index(spark, folder)


def op11_spelling(spark: SparkSession, d: str) -> DataFrame:
    return spelling.variants(table(spark, d, "documents"))


def op12_alignment(spark: SparkSession, d: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.rate(alignment.align(table(spark, d, "documents"), *paths, digest=True)).withColumnRenamed("groups", "groups_sha256")


def op13_chat(spark: SparkSession, d: str) -> DataFrame:
    told = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    spoken = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", spoken), (-7, 1, "assistant", spoken)], told.schema)
    return chat.digest(chat.conversations(told.unionByName(extra)))


QUERIES = {
    q.__name__: q
    for q in (
        op1_language, op2_rendezvous, op3_warc, op4_neighbours, op5_decontaminate, op6_jaccard, op7_sentencepiece, op8_brown, op9_toxicity, op10_orc_ids,
        op11_spelling, op12_alignment, op13_chat,
    )
}
#: The others fit models, search with a stopping test or call a tokenizer; tests hold them against plain versions.
SQL = {
    "op2_rendezvous": checks.op2(SHARDS, sharding.ROWS_PER_RUN), "op3_warc": checks.op3(), "op5_decontaminate": checks.op5(decontaminate.WINDOW), "op6_jaccard": checks.op6(3, 90),
    "op11_spelling": checks.op11(spelling.MIN_LENGTH, spelling.MIN_COUNT, spelling.RATIO, spelling.ERASED_ONE_IN), "op13_chat": checks.op13(),
}
