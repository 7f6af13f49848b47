"""The registered queries: each applies one operator, as it would run in production, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.bpe_automaton import load_vocabulary, with_decoded_text, with_token_ids
from rankloom.llm.decontamination import benchmark_overlap, overlap_digest
from rankloom.llm.html_extract import extract_pages
from rankloom.llm.langid import fit, held_out, with_language
from rankloom.llm.mixing import mix_sources
from rankloom.llm.pii import pii_digest, with_pii
from rankloom.llm.secret_scan import scan
from rankloom.llm.shared import table
from rankloom.llm.simhash import simhash_components
from rankloom.llm.source_divergence import audit_sources
from rankloom.llm.suffix_dedup import remove_repeats
from rankloom.llm.topk_search import top_k
from rankloom.llm.toxicity import THRESHOLD, with_toxicity
from rankloom.llm.toxicity import fit as fit_toxicity
from rankloom.llm.vector_codes import compress_vectors


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents"))


def op2_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    return extract_pages(table(spark, folder, "pages"), keep=["page_id", "url"])


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"))


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return overlap_digest(benchmark_overlap(docs, table(spark, folder, "benchmark"), keep_text=False))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels")
    model = fit_toxicity(docs, labels.where(~held_out(F.col("doc_id"))))
    found = with_toxicity(docs, model, keep=["doc_id"])
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted)


def op6_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii_digest(with_pii(table(spark, folder, "documents"), keep=["doc_id"]))


def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return scan(docs, ~held_out(F.col("doc_id"))).select("doc_id", "kind", "start", "end", "score", "is_secret")


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_components(table(spark, folder, "documents"))


def op10_langid(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    key = F.col("doc_id")
    model = fit(docs.where(~held_out(key)), "text", "lang", key)
    found = with_language(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out(key).alias("held_out"), "lang_pred", "score")


def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return audit_sources(table(spark, folder, "documents"))


def op12_bpe_automaton(spark: SparkSession, folder: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    automaton = load_vocabulary(vocabulary)
    ids = with_token_ids(table(spark, folder, "documents"), automaton, keep=["doc_id"])
    decoded = with_decoded_text(ids, automaton)
    digests = [F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256")]
    return decoded.select("doc_id", "n_tokens", *digests)


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return compress_vectors(table(spark, folder, "embeddings"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_html_extract": op2_html_extract,
    "op3_mixing": op3_mixing,
    "op4_decontamination": op4_decontamination,
    "op5_toxicity": op5_toxicity,
    "op6_topk_search": op6_topk_search,
    "op7_pii": op7_pii,
    "op8_secret_scan": op8_secret_scan,
    "op9_simhash": op9_simhash,
    "op10_langid": op10_langid,
    "op11_source_divergence": op11_source_divergence,
    "op12_bpe_automaton": op12_bpe_automaton,
    "op13_vector_codes": op13_vector_codes,
}
