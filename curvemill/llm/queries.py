"""The registered corpus queries, one for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from curvemill.llm import alignment, brown, decontaminate, licenses, minhash, mixing, pii, quality, spelling, tokens, transducer, urls, warc
from curvemill.llm.shared import table

#: The public tokenizer files of op8, op12 and the pipeline, of op11, and the other one of op12.
TOKENIZER, WORD_TOKENIZER, PIECES = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_bpe(name: str = TOKENIZER) -> str:
    return tokenizer(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.train(urls.labelled_sample(pages)), keep=["page_id"])


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spark, table(spark, sf_dir, "pages")).drop("url", "payload")


def op4_class_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text")).drop("text")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.tokenize(spark, docs, byte_bpe())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), ["doc_id"])


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer(WORD_TOKENIZER))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer(TOKENIZER), tokenizer(PIECES))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_source_mix": op2_source_mix,
    "op3_warc_archive": op3_warc_archive,
    "op4_class_model": op4_class_model,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_benchmark_leaks": op6_benchmark_leaks,
    "op7_personal_data": op7_personal_data,
    "op8_token_files": op8_token_files,
    "op9_quality_rules": op9_quality_rules,
    "op10_license_scan": op10_license_scan,
    "op11_bpe_transducer": op11_bpe_transducer,
    "op12_token_alignment": op12_token_alignment,
    "op13_spelling_variants": op13_spelling_variants,
}

#: Queries that SQL can express. The others are tested against brute force in tests/llm.
ORACLE_SQL = {
    "op2_source_mix": mixing.MIX_SQL,
    "op3_warc_archive": warc.WARC_SQL,
    "op6_benchmark_leaks": decontaminate.DECONTAMINATE_SQL,
    "op13_spelling_variants": spelling.VARIANTS_SQL,
}
