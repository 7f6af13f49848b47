"""A corpus through five stages: toxicity, near-duplicates, benchmark passages, personal data, mixing.

Each stage takes what the one before has kept, written as Parquet and read again, and
returns the columns of ``documents``; the last returns the share of each document in
the mix. Null texts count as empty, repeated rows as near-duplicates of each other, and
columns beyond the known ones pass through to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.decontamination import benchmark_overlap
from rankloom.llm.langid import held_out
from rankloom.llm.mixing import mix_sources
from rankloom.llm.pii import with_pii
from rankloom.llm.shared import staged, table
from rankloom.llm.simhash import MAX_BITS, SHINGLE_WORDS, simhash_components
from rankloom.llm.toxicity import THRESHOLD, fit, with_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier of op5 scores below its threshold; trained on the labels of
    the same part of the documents (op5 keeps a third of them out)."""
    labels = table(spark, folder, "labels")
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    scored = with_toxicity(docs.withColumns({f"__own_{c}": F.col(c) for c in docs.columns if c == "score"}), model)
    kept = scored.where(F.col("score") < THRESHOLD).drop("score")
    return kept.withColumnsRenamed({f"__own_{c}": c for c in docs.columns if c == "score"}).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each component of op9 (four-word shingles, fingerprints at 4 bits or fewer):
    the one with the smallest doc_id, a null id only if all are null, of repeated rows any one.
    All texts without words are one component."""
    rows = staged(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered-documents")
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row").alias("__name")
    found = simhash_components(rows.select(name, "text"), doc_id="__name", words=SHINGLE_WORDS, limit=MAX_BITS)
    # Those that go are far fewer than those that stay.
    dropped = found.where("__name.__row != component_id.__row").select("__name.__row")
    return rows.join(staged(dropped, "dropped-rows"), "__row", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in which no window of ten words of a benchmark item occurs."""
    new = ("n_words", "hit_runs", "hit_items")
    own = {c: f"__own_{c}" for c in docs.columns if c in new}
    found = benchmark_overlap(docs.withColumnsRenamed(own), table(spark, folder, "benchmark"))
    return found.where(F.size("hit_runs") == 0).drop(*new).withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, their personal data replaced by its kind in brackets; ``n_chars`` follows the text."""
    new = ("pii_spans", "pii_redacted")
    own = {c: f"__own_{c}" for c in docs.columns if c in new}
    renamed = docs.withColumnsRenamed(own)
    found = with_pii(renamed, keep=[c for c in renamed.columns if c != "text"])
    found = found.withColumn("text", F.col("pii_redacted")).drop(*new)
    found = found.withColumnsRenamed({v: k for k, v in own.items()})
    if "n_chars" in docs.columns:
        changed = F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)
        found = found.withColumn("n_chars", F.coalesce(changed, F.col("n_chars")))
    return found.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """A row for each document: how many of its words the mix takes, repeats counted."""
    return mix_sources(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("mixing", mix),
]

#: Trained scores and fingerprint components are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, folder), f"stage-{name}")
    return STAGES[-1][1](spark, docs, folder)
