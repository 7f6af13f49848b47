"""Registered queries: every operator over the given tables, whole and in one form.

Doubles are rounded where another engine may sum in another order.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.constants import (
    BASELINE_SCORES,
    MODEL_FEATURES,
    QUICK_GRID,
    QUESTION_TYPES,
    SPLITS,
)
from rankloom.functions.extract import first_text
from rankloom.functions.text import normalize_whitespace, question_type, title_word_count, tokenize
from rankloom.operators import baseline, bm25, classification, lexical, model, pairs, qa, ranking, statistics, tfidf, vector_store
from rankloom.operators.digest import sample_exact
from rankloom.operators.features import feature_table, score_table
from rankloom.operators.semantic import vector_cosines
from rankloom.operators.splits import (
    concat_splits,
    keep_questions,
    split_by_hash,
    split_by_question,
    split_leaks,
)
from rankloom.operators.summary import split_summary
from rankloom.plans.views import (
    doc_scores_view,
    opened_qa_view,
    pairs_view,
    qa_view,
    table,
    text_vectors_view,
    vector_pairs_view,
)
from rankloom.session import scratch_path
from rankloom.sources.readers import read_records
from rankloom.sources.writers import stage, write_csv

Query = Callable[[SparkSession, str], DataFrame]
DIGITS = 6
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Register under the function's name; a trailing underscore only avoids a clash."""
    QUERIES[function.__name__.rstrip("_")] = function
    return function


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column."""
    return df.select(
        *[
            F.round(F.col(f"`{name}`"), digits).alias(name) if kind == "double" else F.col(f"`{name}`")
            for name, kind in df.dtypes
        ]
    )


def plain_names(df: DataFrame) -> DataFrame:
    """precision@3 -> precision_at_3: names that need no quoting in SQL."""
    return df.toDF(*[c.replace("@", "_at_") for c in df.columns])


# --- Sources and ingest ------------------------------------------------------------


def _qa_of_records(records: DataFrame) -> DataFrame:
    return qa.build_qa(records, ids="digest")


@query
def scan_csv_roundtrip(spark, folder):
    path = scratch_path(spark, "qa-csv")
    write_csv(qa_view(spark, folder).select(F.col("question_id").alias("id"), "question", "answer"), path)
    return _qa_of_records(read_records(spark, "csv", path, multiline_csv=True))


@query
def scan_jsonl_roundtrip(spark, folder):
    """Answers as plain strings, lists and objects by turn."""
    turns = qa_view(spark, folder)
    answer = (
        F.when(F.col("turn") % 3 == 0, F.to_json(F.struct(F.array(F.lit(""), "answer").alias("answer"))))
        .when(
            F.col("turn") % 3 == 1,
            F.to_json(F.struct(F.struct(F.lit("").alias("text"), F.col("answer").alias("value")).alias("answer"))),
        )
        .otherwise(F.to_json(F.struct("answer")))
    )
    head = F.to_json(F.struct(F.col("question_id").alias("id"), "question"))
    # {"id":..,"question":..} and {"answer":..} become one object.
    line = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(","), F.substring(answer, F.lit(2), F.length(answer)))
    path = scratch_path(spark, "qa-jsonl")
    turns.select(line.alias("value")).write.text(path)
    return _qa_of_records(read_records(spark, "jsonl", path, irregular=["answer"]))


@query
def scan_parquet_qa(spark, folder):
    exported = stage(
        qa_view(spark, folder).select(F.col("question_id").alias("id"), "question", F.array("answer").alias("answer")),
        "qa-export",
    )
    return _qa_of_records(read_records(spark, "parquet", exported.inputFiles()))


@query
def sample_exact_n(spark, folder):
    return sample_exact(table(spark, folder, "documents"), 100, F.col("doc_id")).select("doc_id", "lang", "source")


@query
def sample_then_split(spark, folder):
    """What a sample keeps must not decide the split of the same seed."""
    chosen = sample_exact(table(spark, folder, "documents"), 400, F.col("doc_id"))
    return split_by_hash(chosen.select(F.col("doc_id").cast("string").alias("question_id")))


@query
def extract_first_text_json_order(spark, folder):
    """Objects whose unknown keys are out of name order: the first in the text counts."""
    answer = F.concat(F.lit('{"zeta": '), F.to_json(F.struct(F.col("answer").alias("x"))), F.lit(', "alpha": "no"}'))
    rows = qa_view(spark, folder).select("question_id", answer.alias("answer"))
    path = scratch_path(spark, "irregular")
    rows.select(F.format_string('{"question_id": "%s", "answer": %s}', "question_id", "answer").alias("value")).write.text(path)
    records = read_records(spark, "jsonl", path, irregular=["answer"])
    return records.select("question_id", first_text(F.col("answer"), records.schema["answer"].dataType).alias("answer"))


@query
def extract_first_text_array(spark, folder):
    nested = qa_view(spark, folder).select("question_id", F.array(F.lit(""), "answer").alias("answers"))
    return nested.select("question_id", first_text(F.col("answers"), nested.schema["answers"].dataType).alias("answer"))


@query
def extract_first_text_struct(spark, folder):
    """The preferred field is null for even turns, blank for every other odd one."""
    text = F.when(F.col("turn") % 4 == 1, "  ").when(F.col("turn") % 2 == 1, F.col("question"))
    nested = qa_view(spark, folder).select(
        "question_id", F.struct(F.col("answer").alias("value"), text.alias("text")).alias("cell")
    )
    return nested.select("question_id", first_text(F.col("cell"), nested.schema["cell"].dataType).alias("answer"))


@query
def answer_fallback_coalesce(spark, folder):
    records = qa_view(spark, folder).select(
        "question_id",
        F.when(F.col("turn") % 2 == 0, F.col("answer")).alias("answer"),
        F.when(F.col("turn") % 4 == 1, F.array(F.lit(" "), "answer")).alias("short_answers"),
        F.struct(F.col("question").alias("text")).alias("long_answer"),
    )
    return records.select("question_id", qa.answer_text(records, "answer").alias("answer"))


@query
def filter_nonempty_qa(spark, folder):
    records = table(spark, folder, "conversations").select(
        F.concat_ws("_", "conv_id", "turn").alias("id"),
        F.col("text").alias("question"),
        F.when(F.col("role") == "assistant", F.col("text")).when(F.col("role") == "user", " \t").alias("answer"),
        "conv_id",
        "turn",
    )
    found = qa.extract_qa(records, [F.col("conv_id"), F.col("turn")])
    return found.select("source_example_id", "question", "answer")


@query
def dedup_keep_first(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return qa.first_per_question(docs, "text", "doc_id")


@query
def assign_question_ids(spark, folder):
    numbered = pairs.number_questions(qa_view(spark, folder).drop("question_id"), [F.col("conv_id"), F.col("turn")])
    return numbered.select("question_id", "conv_id", "turn", "question")


# --- Text functions ----------------------------------------------------------------


def _documents(spark, folder) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


@query
def normalize_whitespace_(spark, folder):
    return _documents(spark, folder).select("doc_id", normalize_whitespace(F.col("text")).alias("text"))


@query
def tokenize_(spark, folder):
    return _documents(spark, folder).select("doc_id", F.array_join(tokenize(F.col("text")), "|").alias("tokens"))


@query
def question_type_(spark, folder):
    return opened_qa_view(spark, folder).select("question_id", question_type(F.col("question")).alias("question_type"))


@query
def named_entity_heuristic(spark, folder):
    return _documents(spark, folder).select("doc_id", title_word_count(F.col("text")).alias("named_entity_count"))


@query
def one_hot_question_type(spark, folder):
    kinds = opened_qa_view(spark, folder).select("question_id", question_type(F.col("question")).alias("t"))
    return kinds.select("question_id", *lexical.one_hot(F.col("t"), QUESTION_TYPES, "qtype_"))


# --- Pairs and splits --------------------------------------------------------------


def _pair_columns(df: DataFrame) -> DataFrame:
    return df.select("pair_id", "question_id", "document", "label", "pair_type", "source_doc_question_id")


@query
def positive_pairs(spark, folder):
    return _pair_columns(pairs.positive_pairs(opened_qa_view(spark, folder)))


@query
def negative_sampling(spark, folder):
    return _pair_columns(pairs.negative_pairs(opened_qa_view(spark, folder), 3))


def _docs_as_answers(spark, folder) -> DataFrame:
    """Documents as answers: many have exact copies, so negatives can equal positives."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("question_id"), F.col("source").alias("question"), F.col("text").alias("answer")
    )


@query
def negative_sampling_other_text(spark, folder):
    drawn = pairs.negative_pairs(_docs_as_answers(spark, folder), 3, exclude_same_text=True)
    return drawn.select("pair_id", "question_id", "document", "source_doc_question_id")


@query
def assign_pair_ids(spark, folder):
    return pairs.number_pairs(pairs_view(spark, folder)).select(
        "pair_id", "question_id", "label", "source_doc_question_id"
    )


@query
def false_negative_audit(spark, folder):
    return pairs.false_negatives(stage(pairs.build_pairs(_docs_as_answers(spark, folder), 3), "doc-pairs"))


@query
def split_exact_counts(spark, folder):
    return split_by_question(pairs_view(spark, folder)).select("pair_id", "question_id", "split")


@query
def split_hash_bucket(spark, folder):
    return split_by_hash(pairs_view(spark, folder)).select("pair_id", "question_id", "split")


@query
def split_semi_join(spark, folder):
    held_out = split_by_hash(qa_view(spark, folder)).where("split <> 'train'")
    return keep_questions(pairs_view(spark, folder), held_out).select("pair_id", "question_id", "label")


@query
def split_leakage_check(spark, folder):
    """Leaking questions (none) and how many questions each split has."""
    split = split_by_question(pairs_view(spark, folder))
    leaks = split_leaks(split).agg(F.count("*")).scalar()
    return split.groupBy("split").agg(F.countDistinct("question_id").alias("questions")).withColumn("leaks", leaks)


@query
def features_union_splits(spark, folder):
    split = stage(
        split_by_question(lexical.with_lexical_features(pairs_view(spark, folder))).select(
            "pair_id", "token_overlap", "document_length", "question_type", "split"
        ),
        "lexical",
    )
    return concat_splits({name: split.where(F.col("split") == name).drop("split") for name in SPLITS})


@query
def dataset_summary(spark, folder):
    return rounded(split_summary(split_by_question(pairs_view(spark, folder))))


# --- Features ----------------------------------------------------------------------


def _lexical(spark, folder) -> DataFrame:
    return lexical.with_lexical_features(pairs_view(spark, folder))


@query
def token_overlap(spark, folder):
    return rounded(_lexical(spark, folder).select("pair_id", "token_overlap", "token_overlap_ratio"))


@query
def text_lengths(spark, folder):
    return _lexical(spark, folder).select("pair_id", "query_length", "document_length")


@query
def interaction_features(spark, folder):
    base = pairs_view(spark, folder)
    scored = feature_table(base, vectors=text_vectors_view(spark, folder, base))
    return rounded(scored.select("pair_id", "similarity_times_doc_length", "normalized_overlap"), 4)


@query
def distinct_documents(spark, folder):
    return bm25.distinct_documents(table(spark, folder, "documents"), "text")


@query
def bm25_term_idf(spark, folder):
    return rounded(bm25.term_weights(bm25.corpus_table(table(spark, folder, "documents"), "text")))


@query
def bm25_pair_score(spark, folder):
    return rounded(bm25.with_bm25(pairs_view(spark, folder)).select("pair_id", "bm25_score"))


@query
def bm25_reference_corpus(spark, folder):
    """Corpus: the documents that are somebody's positive in the train split; others NaN."""
    split = stage(split_by_hash(pairs_view(spark, folder)), "pairs-split")
    corpus = split.where("split = 'train' AND label = 1").select("document")
    scored = bm25.with_bm25(split, corpus).select("pair_id", "bm25_score")
    return _known_scores(scored)


def _known_scores(scored: DataFrame) -> DataFrame:
    return rounded(scored.withColumn("in_corpus", (~F.isnan("bm25_score")).cast("int")).withColumn(
        "bm25_score", ranking.nan_to_null(F.col("bm25_score"))
    ))


def _halves(df: DataFrame, name: str) -> list[DataFrame]:
    """Two parts of a table that share every sixteenth row, by the hash of a column."""
    place = F.pmod(F.xxhash64(name), F.lit(16))
    return [df.where(place < 8), df.where(place >= 7)]


@query
def bm25_idf_from_batches(spark, folder):
    """Statistics added up over two batches with common documents: as those of one corpus."""
    path = scratch_path(spark, "bm25-statistics")
    for part in _halves(table(spark, folder, "documents").select("doc_id", "text"), "doc_id"):
        statistics.add_documents(part, path, "text")
    return rounded(statistics.saved_term_weights(spark, path))


@query
def tfidf_idf_from_batches(spark, folder):
    path, docs = scratch_path(spark, "tfidf-statistics"), table(spark, folder, "documents").select("doc_id", "text")
    even = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    for part in (docs.where(even), docs.where(~even)):
        statistics.add_fit_texts(part, path)
    return rounded(statistics.saved_gram_weights(spark, path).select("gram", "df", "idf"))


@query
def bm25_saved_corpus(spark, folder):
    """``bm25_reference_corpus`` by statistics that were saved before, batch by batch."""
    split, path = stage(split_by_hash(pairs_view(spark, folder)), "pairs-split"), scratch_path(spark, "bm25-statistics")
    for part in _halves(split.where("split = 'train' AND label = 1"), "pair_id"):
        statistics.add_documents(part, path)
    scored = statistics.with_saved_bm25(split, path).select("pair_id", "bm25_score")
    return _known_scores(scored)


@query
def vector_store_runs(spark, folder):
    """Two runs over the documents, the second over all of them: (run, encoded, stored)."""
    path, docs = scratch_path(spark, "vector-store"), table(spark, folder, "documents").select("doc_id", "text")
    encoder = lambda text: F.array(F.length(text).cast("float"), F.ascii(text).cast("float"))
    runs = []
    for i, part in enumerate((docs.where(F.pmod("doc_id", F.lit(2)) == 0), docs, docs), 1):
        lacking = vector_store.missing_texts(part, vector_store.stored_vectors(spark, path, "stand-in"))
        encoded = stage(lacking.agg(F.count("*").alias("encoded")), "encoded")
        # Counted now: within one plan, scans of one folder are taken for the same.
        stored = stage(vector_store.add_texts(part, encoder, "stand-in", path).agg(F.count("*").alias("stored")), "stored")
        runs.append(encoded.select(F.lit(i).cast("bigint").alias("run"), "encoded", stored.scalar().alias("stored")))
    return functools.reduce(DataFrame.unionByName, runs)


@query
def tfidf_idf(spark, folder):
    return rounded(tfidf.gram_weights(_documents(spark, folder).select("text")).select("gram", "df", "idf"))


@query
def tfidf_similarity(spark, folder):
    return rounded(tfidf.with_tfidf(pairs_view(spark, folder)).select("pair_id", "tfidf_similarity"))


def _vector_scores(spark, folder) -> DataFrame:
    scored = vector_cosines(
        vector_pairs_view(spark, folder), table(spark, folder, "embeddings"), "q_vec", "d_vec", "vec_id"
    )
    return scored.withColumn("score", F.round("semantic_cosine_similarity", DIGITS))


@query
def semantic_cosine(spark, folder):
    return _vector_scores(spark, folder).select("pair_id", F.col("score").alias("semantic_cosine_similarity"))


def _features(spark, folder) -> DataFrame:
    base = pairs_view(spark, folder)
    return feature_table(base, vectors=text_vectors_view(spark, folder, base))


@query
def feature_table_(spark, folder):
    return rounded(_features(spark, folder), 4)


@query
def model_matrix(spark, folder):
    """The 17 inputs; floats are shown as rounded doubles."""
    matrix = model.model_matrix(_features(spark, folder))
    return rounded(matrix.select("pair_id", "label", *[F.col(c).cast("double").alias(c) for c in MODEL_FEATURES]), 2)


# --- Ranking -----------------------------------------------------------------------


def _scored_pairs(spark, folder) -> DataFrame:
    """Pairs scored by overlap ratio: exact fractions, with ties."""
    return stage(_lexical(spark, folder).select("pair_id", "question_id", "label", F.col("token_overlap_ratio").alias("y_prob")), "scored")


def _per_question(spark, folder) -> DataFrame:
    return plain_names(rounded(ranking.question_metrics(_scored_pairs(spark, folder))))


def _by_question(*columns: str) -> Query:
    return lambda spark, folder: _per_question(spark, folder).select("question_id", *columns)


QUERIES["precision_at_k"] = _by_question("precision_at_1", "precision_at_3", "precision_at_5")
QUERIES["reciprocal_rank"] = _by_question("rr")
QUERIES["dcg_at_k"] = _by_question("dcg_at_1", "dcg_at_3", "dcg_at_5")
QUERIES["ndcg_at_k"] = _by_question("ndcg_at_1", "ndcg_at_3", "ndcg_at_5")


@query
def ranking_metrics(spark, folder):
    """Vectors as questions, some of them without any relevant candidate."""
    scored = stage(_vector_scores(spark, folder).select("pair_id", "question_id", "label", "score"), "scored")
    return plain_names(rounded(ranking.ranking_metrics(scored, score="score")))


def _stable_scores(spark, folder, *names: str) -> DataFrame:
    """The named baseline scores (all three, unless named), rounded so that engines rank alike."""
    base, names = pairs_view(spark, folder), names or tuple(BASELINE_SCORES.values())
    vectors = text_vectors_view(spark, folder, base) if "semantic_cosine_similarity" in names else None
    return stage(rounded(score_table(base, list(names), vectors)), "scores")


def _top(score: str) -> Query:
    def run(spark, folder):
        scored = _stable_scores(spark, folder, score)
        scored = scored.withColumn(score, ranking.fill_missing(F.col(score), 0.0))
        return ranking.top_k(scored, score, 3, ["question_id"]).select("question_id", "pair_id", "label", score)

    return run


def _single(score: str) -> Query:
    return lambda spark, folder: plain_names(
        rounded(baseline.single_score_baseline(_stable_scores(spark, folder, score), score, fill=0.0))
    )


for _name, _score in BASELINE_SCORES.items():
    QUERIES[f"topk_{_name}"] = _top(_score)
    QUERIES[f"baseline_{_name}"] = _single(_score)


@query
def baseline_comparison(spark, folder):
    return plain_names(rounded(baseline.compare_baselines(_stable_scores(spark, folder))))


@query
def metric_gain(spark, folder):
    """TF-IDF over all candidates against semantic top-3."""
    scored = _stable_scores(spark, folder, "tfidf_similarity", "semantic_cosine_similarity")
    ours = ranking.ranking_metrics(scored, score="tfidf_similarity")
    theirs = baseline.single_score_baseline(scored, "semantic_cosine_similarity")
    return rounded(baseline.metric_gain(ours, theirs))


# --- Classification and curves -----------------------------------------------------


def _doc_scores(spark, folder) -> DataFrame:
    return doc_scores_view(spark, folder)


@query
def threshold_predictions(spark, folder):
    return _doc_scores(spark, folder).select("doc_id", "label", classification.decide(F.col("y_prob")).alias("y_pred"))


@query
def classification_metrics(spark, folder):
    return rounded(classification.classification_metrics(_doc_scores(spark, folder), "label", "y_prob"))


@query
def auroc(spark, folder):
    return rounded(classification.auroc(_vector_scores(spark, folder), "label", "score"))


@query
def confusion_matrix(spark, folder):
    predicted = _doc_scores(spark, folder).withColumn("y_pred", classification.decide(F.col("y_prob")))
    return classification.confusion_matrix(predicted, "label", "y_pred")


@query
def score_histogram(spark, folder):
    return rounded(classification.score_histogram(_doc_scores(spark, folder), "label", "y_prob"))


@query
def roc_curve(spark, folder):
    return rounded(classification.roc_curve(_vector_scores(spark, folder), "label", "score"))


@query
def roc_curve_all_points(spark, folder):
    scored = _vector_scores(spark, folder)
    return rounded(classification.roc_curve(scored, "label", "score", drop_intermediate=False))


@query
def pr_curve(spark, folder):
    return rounded(classification.pr_curve(_vector_scores(spark, folder), "label", "score"))


@query
def threshold_sweep(spark, folder):
    return rounded(classification.threshold_sweep(_doc_scores(spark, folder), "label", "y_prob"))


@query
def operating_point(spark, folder):
    sweep = classification.threshold_sweep(_vector_scores(spark, folder), "label", "score")
    return rounded(classification.best_threshold(sweep))


def _metrics_by_split(spark, folder) -> DataFrame:
    split = split_by_question(_scored_pairs(spark, folder))
    return classification.all_metrics(stage(split, "scored-split"), "label", "y_prob", by=["split"])


@query
def all_metrics(spark, folder):
    return rounded(_metrics_by_split(spark, folder))


@query
def metrics_pivot(spark, folder):
    return rounded(baseline.pivot_splits(_metrics_by_split(spark, folder), SPLITS))


# --- Model (scores have no SQL form, their properties have) ----------------------

def _model_features(spark, folder) -> DataFrame:
    base = stage(split_by_question(pairs_view(spark, folder)), "pairs-split")
    return stage(feature_table(base, vectors=text_vectors_view(spark, folder, base)), "features")


def _all(column: Column) -> Column:
    """1 if it holds of every row."""
    return F.min(column.cast("bigint")).alias("value")


def _checks(parts: dict[str, DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("check"), "value") for name, df in parts.items()])


@query
def train_and_score(spark, folder):
    features = _model_features(spark, folder)
    return model.evaluate(model.train(features), features)


@query
def model_checks(spark, folder):
    """What must hold of a trained model whatever its trees: (check, value), counts and 1 for true."""
    features = _model_features(spark, folder)
    trained = model.train(features)
    metrics = stage(model.evaluate(trained, features), "metrics")
    weights = model.importance_table(trained, spark)
    right = (F.col("y_prob") >= 0.5).cast("int") == F.col("label")
    again = model.score(trained, features).groupBy("split").agg(F.avg(right.cast("int")).alias("again"))
    agree = metrics.where("metric = 'accuracy'").join(again, "split")
    parts = {
        "features": weights.agg(F.count("*").alias("value")),
        "importance adds up to 1": weights.agg((F.abs(F.sum("importance") - 1) < 1e-6).cast("bigint").alias("value")),
        "metrics": metrics.agg(F.count("*").alias("value")),
        "metrics from 0 to 1": metrics.agg(_all(F.col("value").between(0, 1))),
        "accuracy of the scored rows": agree.agg(_all(F.abs(F.col("value") - F.col("again")) < 1e-9)),
        "scored pairs": model.score(trained, features).agg(F.count("*").alias("value")),
    }
    return _checks(parts)


@query
def feature_importance(spark, folder):
    return model.importance_table(model.train(_model_features(spark, folder)), spark)


@query
def top_features(spark, folder):
    trained = model.train(_model_features(spark, folder))
    return model.top_features(model.importance_table(trained, spark))


@query
def training_curve(spark, folder):
    """What must hold of the curve over the evaluation sets: (check, value)."""
    features = _model_features(spark, folder)
    trained = model.train(features)
    curve = stage(model.training_curve(trained, features), "curve")
    metrics = model.evaluate(trained, features).where("metric = 'auroc'").select("split", F.col("value").alias("whole"))
    last = curve.where(F.col("round") == len(trained.trees)).join(metrics, "split")
    losses = curve.where("split = 'train'").agg(F.max_by("log_loss", "round").alias("last"), F.min_by("log_loss", "round").alias("first"))
    parts = {
        "points": curve.agg(F.count("*").alias("value")),
        "rounds": curve.agg(F.max("round").cast("bigint").alias("value")),
        "last round is the model": last.agg(F.sum((F.abs(F.col("auroc") - F.col("whole")) < 1e-9).cast("bigint")).alias("value")),
        "auroc and error from 0 to 1": curve.agg(_all(F.col("auroc").between(0, 1) & F.col("error").between(0, 1))),
        "training loss falls": losses.select((F.col("last") < F.col("first")).cast("bigint").alias("value")),
    }
    return _checks(parts)


@query
def tune_checks(spark, folder):
    """What must hold of a grid search: (check, value)."""
    best, settings, results = model.grid_search(_model_features(spark, folder), QUICK_GRID)
    same = functools.reduce(lambda a, b: a & b, [F.col(n) == float(settings[n]) for n in QUICK_GRID])
    top = results.select(F.min_by("grid_idx", F.struct(-F.col("auroc"), F.col("grid_idx"))).alias("top"))
    parts = {
        "settings rated": results.agg(F.count_distinct(*QUICK_GRID).cast("bigint").alias("value")),
        "first of the highest auroc is taken": results.where(same).agg(_all(F.col("grid_idx") == top.scalar())),
        "metrics from 0 to 1": results.agg(_all(functools.reduce(lambda a, b: a & b, [F.col(c).between(0, 1) for c in ("auroc", "mrr", "f1")]))),
        "trees of the best": results.limit(1).select((F.lit(len(best.trees)) == settings["n_estimators"]).cast("bigint").alias("value")),
    }
    return _checks(parts)


@query
def tune_best(spark, folder):
    _, settings, results = model.grid_search(_model_features(spark, folder), QUICK_GRID)
    chosen = F.lit(True)
    for name in QUICK_GRID:
        chosen = chosen & (F.col(name) == float(settings[name]))
    return results.where(chosen)
