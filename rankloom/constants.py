"""Names, word lists and settings that results depend on."""

# --- Fixed values -----------------------------------------------------------
# They have to equal the published ones for the results to be comparable.

QUESTION_WORDS = ["who", "what", "when", "where", "why", "how"]
QUESTION_TYPES = ["who", "what", "when", "where", "why", "how", "other"]

QUESTION_FIELDS = ["question", "query", "question_text"]
ANSWER_FIELDS = [
    "answer",
    "answers",
    "short_answer",
    "short_answers",
    "long_answer",
    "document",
]
ID_FIELDS = ["id", "example_id", "question_id"]
ANSWER_FALLBACK_FIELDS = ["answers", "annotations", "short_answers", "long_answer"]
NESTED_TEXT_KEYS = [
    "text",
    "answer",
    "value",
    "span",
    "short_answers",
    "short_answer",
    "long_answer",
    "answers",
]

PAIR_COLUMNS = [
    "pair_id",
    "question_id",
    "question",
    "document",
    "label",
    "pair_type",
    "source_doc_question_id",
]
FEATURE_COLUMNS = [
    "semantic_cosine_similarity",
    "token_overlap",
    "token_overlap_ratio",
    "tfidf_similarity",
    "bm25_score",
    "document_length",
    "query_length",
    "question_type",
    "named_entity_count",
    "similarity_times_doc_length",
    "normalized_overlap",
]
NUMERIC_FEATURES = [c for c in FEATURE_COLUMNS if c != "question_type"]
MODEL_FEATURES = NUMERIC_FEATURES + [f"qtype_{t}" for t in QUESTION_TYPES]
KEY_COLUMNS = ["split"] + PAIR_COLUMNS

SPLITS = ["train", "validation", "test"]
RANK_CUTOFFS = [1, 3, 5]
CLASSIFICATION_METRICS = ["accuracy", "precision", "recall", "f1", "auroc"]
DECISION_THRESHOLD = 0.5
HISTOGRAM_BINS = 50
TOP_FEATURES = 15
BASELINE_TOP_K = 3
BASELINE_SCORES = {
    "semantic": "semantic_cosine_similarity",
    "bm25": "bm25_score",
    "tfidf": "tfidf_similarity",
}

BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25

MODEL_DEFAULTS = {
    "max_depth": 6,
    "learning_rate": 0.1,
    "n_estimators": 100,
    "min_child_weight": 1,
    "subsample": 0.9,
    "colsample_bytree": 0.7,
    "scale_pos_weight": 3,
    "random_state": 42,
}
QUICK_GRID = {
    "max_depth": [5, 7, 9],
    "learning_rate": [0.05, 0.1],
    "n_estimators": [100, 200],
    "scale_pos_weight": [1, 3],
}
FULL_GRID = {
    "max_depth": [4, 6, 8, 10],
    "learning_rate": [0.01, 0.05, 0.1],
    "n_estimators": [100, 200, 300],
    "min_child_weight": [1, 3, 5],
    "subsample": [0.7, 0.8, 0.9],
    "colsample_bytree": [0.7, 0.8, 0.9],
    "scale_pos_weight": [1, 2, 3],
}
