"""Corpus statistics that are kept and grow: fitted on some texts, added to, used later.

A folder holds partial counts per batch; what scoring needs is their sum. BM25 counts each
different document once, so the keys of all documents are kept too, and a batch brings only
those that are new. TF-IDF counts copies, so its batches just add up; its many grams are kept as
lists, one row per part of the grams and batch.

The table ``batches`` is written last, one row in one file per batch. Counts whose batch is
not in it come from a run that failed and are not read.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rankloom.functions.counts import TOTALS, merged_lists, total_lists, total_rows
from rankloom.functions.text import explode_rows
from rankloom.operators.bm25 import corpus_table, idf_of, matched_scores, with_known
from rankloom.operators.tfidf import distinct_texts, idf_of_grams
from rankloom.sources.writers import stage

_BATCHES = "batch string, texts long, tokens long"
_TABLES = {
    "documents": "doc_key binary, batch string",
    "counts": "item string, df long, n_texts long, batch string",
    "grams": f"{TOTALS}, batch string",
}


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)])


def _committed(spark: SparkSession, path: str, name: str) -> DataFrame:
    batches = _read(spark, f"{path}/batches", _BATCHES).select("batch")
    return _read(spark, f"{path}/{name}", _TABLES[name]).join(batches, "batch", "left_semi")


def _commit(path: str, batch: str, tables: dict[str, DataFrame], totals: DataFrame) -> None:
    for name, table in tables.items():
        table.withColumn("batch", F.lit(batch)).write.mode("append").partitionBy("batch").parquet(f"{path}/{name}")
    totals.withColumn("batch", F.lit(batch)).coalesce(1).write.mode("append").parquet(f"{path}/batches")


def add_documents(docs: DataFrame, path: str, text: str = "document") -> None:
    """Add the documents that are not there yet to the BM25 statistics in ``path``.

    Null texts count as ''. Adding the same documents again changes nothing."""
    spark, batch = docs.sparkSession, uuid.uuid4().hex
    known = _committed(spark, path, "documents").select("doc_key")
    new = stage(corpus_table(docs, text).join(known, "doc_key", "left_anti"), "new-documents")
    terms = explode_rows(new, items=F.col("terms"), out="item")
    counts = terms.groupBy("item").agg(F.count("*").alias("df"), F.count("*").alias("n_texts"))
    totals = new.agg(F.count("*").alias("texts"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("tokens"))
    _commit(path, batch, {"documents": new.select("doc_key"), "counts": counts}, totals)


def add_fit_texts(texts: DataFrame, path: str, text: str = "text") -> None:
    """Add texts, copies included, to the TF-IDF statistics in ``path``. Null texts count as ''."""
    own = texts.select(F.col(text).alias("text"))
    grams = merged_lists(total_lists(distinct_texts(own), "weight", "text"))
    totals = own.agg(F.count("*").alias("texts"), F.lit(0).cast("long").alias("tokens"))
    _commit(path, uuid.uuid4().hex, {"grams": grams}, totals)


def _totals(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, f"{path}/batches", _BATCHES).agg(F.sum("texts").alias("texts"), F.sum("tokens").alias("tokens"))


def saved_term_weights(spark: SparkSession, path: str) -> DataFrame:
    """(term, df, idf) of all batches; negative weights are replaced as for one corpus."""
    counts = _committed(spark, path, "counts").groupBy(F.col("item").alias("term")).agg(F.sum("df").alias("df"))
    return idf_of(counts, _totals(spark, path).select("texts").scalar())


def saved_gram_weights(spark: SparkSession, path: str) -> DataFrame:
    """(gram, df, n_texts, idf) of all batches. ``n_texts`` counts a text once per batch."""
    if not _committed(spark, path, "counts").isEmpty():
        raise ValueError("the folder holds counts of single items, as of BM25 or of an earlier version")
    counts = total_rows(_committed(spark, path, "grams")).withColumnRenamed("value", "gram")
    return idf_of_grams(counts, _totals(spark, path).select("texts").scalar())


def _size(spark: SparkSession, path: str) -> Column:
    size = F.struct(F.col("texts").alias("n_docs"), (F.col("tokens") / F.col("texts")).alias("avg_len"))
    return _totals(spark, path).select(size).scalar()


def with_saved_bm25(pairs: DataFrame, path: str, key: str = "pair_id") -> DataFrame:
    """Add ``bm25_score`` by the saved statistics; NaN where the document was never added."""
    spark = pairs.sparkSession
    weights = stage(saved_term_weights(spark, path), "term-weights")
    scores = matched_scores(pairs, weights, _size(spark, path), key)
    scored = pairs.join(scores, key, "left").withColumn("bm25_score", F.coalesce("bm25_score", F.lit(0.0)))
    return with_known(scored, pairs, _committed(spark, path, "documents").select("doc_key"), key)
