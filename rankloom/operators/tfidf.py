"""TF-IDF cosine of given (question, document) pairs over uni- and bigrams.

Three narrow tables carry the work: grams per *distinct* text (for the vector
lengths), gram weights, and the grams a pair shares (for the dot products, found
within the pair's own row). Texts are replaced by 128-bit keys before anything is
exploded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.counts import KEYS, count_rows, shared_rows, total_lists, total_rows
from rankloom.functions.text import normalize_whitespace, text_key
from rankloom.operators.skew import largest, salted_lookup
from rankloom.sources.writers import stage


def pair_texts(pairs: DataFrame) -> DataFrame:
    """All questions and all documents as one text column, repeats included."""
    return pairs.select(F.col("question").alias("text")).unionAll(
        pairs.select(F.col("document").alias("text"))
    )


def distinct_texts(texts: DataFrame) -> DataFrame:
    """(text, weight): every text once, with the number of its copies. Rows may come
    with a weight already."""
    copies = F.sum("weight") if "weight" in texts.columns else F.count("*")
    return texts.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(copies.alias("weight"))


def weighted_pair_texts(qa: DataFrame, pairs: DataFrame) -> DataFrame:
    """(text, weight): what ``pair_texts`` gives, from the table the pairs were built of.

    How often each question and answer occurs follows from ids alone, so every text is
    read once instead of once per pair."""
    asked = pairs.groupBy("question_id").agg(F.count("*").alias("weight"))
    drawn = pairs.groupBy(F.col("source_doc_question_id").alias("question_id")).agg(
        F.count("*").alias("weight")
    )
    return (
        qa.join(asked, "question_id")
        .select(normalize_whitespace(F.col("question")).alias("text"), "weight")
        .unionAll(
            qa.join(drawn, "question_id").select(
                normalize_whitespace(F.col("answer")).alias("text"), "weight"
            )
        )
    )


def text_grams(texts: DataFrame, *keep: str, keyed: bool = False) -> DataFrame:
    """(text_key, gram, tf) and kept columns of a distinct-text table. With ``keyed``, the two
    columns ``KEYS`` of 64 bits each stand for the gram."""
    own = texts.select(text_key(F.col("text")).alias("text_key"), *keep, "text")
    value = KEYS if keyed else ["value AS gram"]
    return count_rows(own, ["text_key", *keep], "text", keyed=keyed).selectExpr("text_key", *value, "n AS tf", *keep)


def gram_totals(texts: DataFrame) -> DataFrame:
    """(gram, df, n_texts) of a distinct-text table with weights."""
    return total_rows(total_lists(texts, "weight", "text")).withColumnRenamed("value", "gram")


def gram_weights(texts: DataFrame) -> DataFrame:
    """(gram, df, n_texts, idf) of a text column, repeats included or given as weights: df and the corpus
    size count copies of a text, n_texts is the number of distinct texts with the gram.
    Grams are counted once per distinct text and weighted by its copies."""
    copies = F.sum("weight") if "weight" in texts.columns else F.count("*")
    return idf_of_grams(gram_totals(distinct_texts(texts)), texts.agg(copies).scalar())


def idf_of_grams(counts: DataFrame, total) -> DataFrame:
    """(gram, df, n_texts, idf) of counts (gram, df, n_texts) in ``total`` texts."""
    return counts.withColumn("idf", F.log((total + 1.0) / (F.col("df") + 1.0)) + 1.0)


def cosines(
    pairs: DataFrame,
    fit_texts: DataFrame | None = None,
    key: str = "pair_id",
    own_texts: DataFrame | None = None,
    weights: DataFrame | None = None,
) -> DataFrame:
    """(key, tfidf_similarity) for the pairs that share at least one known gram.

    ``fit_texts`` (column ``text``) sets vocabulary and weights; without it, or without rows in it,
    the pairs' own texts do. ``own_texts`` may give those as (text, weight). ``weights``
    (gram, df, n_texts, idf) of an earlier corpus take the place of ``fit_texts``."""
    if own_texts is None:
        own_texts = pair_texts(pairs)
    if fit_texts is not None and fit_texts.isEmpty():
        fit_texts = None
    # Every text is cut into grams once; lengths and weights both start from this table.
    different = distinct_texts(own_texts)
    fitted = weights is not None or fit_texts is not None
    # Weights of the texts' own need no names of grams, only keys.
    gram = ["gram"] if fitted else KEYS
    own_grams = stage(text_grams(different, "weight", keyed=not fitted), "text-grams")
    if weights is not None:
        weights = stage(weights, "gram-weights")
    elif fit_texts is None:
        copies = F.sum("weight") if "weight" in own_texts.columns else F.count("*")
        counts = own_grams.groupBy(*gram).agg(F.sum("weight").alias("df"), F.count("*").alias("n_texts"))
        total = own_texts.agg(copies).scalar()
        weights = stage(idf_of_grams(counts, total), "gram-weights")
    else:
        weights = stage(gram_weights(fit_texts), "gram-weights")
    hot_grams = None if fitted else largest(weights, gram, "n_texts")
    idf = weights.select(*gram, "idf")

    if fitted:
        squares = salted_lookup(own_grams, idf, gram, spread="text_key", how="inner", hot=hot_grams)
    else:
        # A gram of one text only, as most are, has that text's copies for its df: nothing to look up.
        common = weights.where("n_texts > 1").select(*gram, "df")
        squares = salted_lookup(own_grams, common, gram, spread="text_key", hot=hot_grams)
        squares = idf_of_grams(squares.withColumn("df", F.coalesce("df", "weight")), total)
    lengths = squares.groupBy("text_key").agg(
        F.expr("sqrt(sum(pow(tf * idf, 2))) AS length")
    )

    keyed = pairs.selectExpr(
        key, "coalesce(question, '') AS question", "coalesce(document, '') AS document"
    )
    keyed = keyed.select("*", text_key(F.col("question")).alias("q_key"), text_key(F.col("document")).alias("d_key"))
    shared = shared_rows(keyed, [key, "q_key", "d_key"], "question", "document", bigrams=True, keyed=not fitted)
    shared = shared.selectExpr(key, "q_key", "d_key", *(["value AS gram"] if fitted else KEYS), "n * query_n AS tf2")
    shared = stage(shared, "shared-grams")
    products = salted_lookup(shared, idf, gram, spread=key, how="inner")
    dots = products.groupBy(key, "q_key", "d_key").agg(
        F.expr("sum(tf2 * idf * idf) AS dot")
    )

    dots, lengths = stage(dots, "dots"), stage(lengths, "text-lengths")
    for side in ("q", "d"):
        side_key = f"{side}_key"
        dots = salted_lookup(
            dots, lengths.selectExpr(f"text_key AS {side_key}", f"length AS {side}_len"), [side_key], spread=key, how="inner"
        )
    return dots.selectExpr(key, "try_divide(dot, q_len * d_len) AS tfidf_similarity")


def with_tfidf(
    pairs: DataFrame,
    fit_texts: DataFrame | None = None,
    key: str = "pair_id",
    texts: DataFrame | None = None,
    own_texts: DataFrame | None = None,
    weights: DataFrame | None = None,
) -> DataFrame:
    """Add ``tfidf_similarity``; pairs without a common gram get 0. ``texts`` is as in
    ``with_bm25``, ``weights`` as in ``cosines``."""
    found = cosines(pairs if texts is None else texts, fit_texts, key, own_texts, weights)
    return pairs.join(found, key, "left").withColumn(
        "tfidf_similarity", F.coalesce("tfidf_similarity", F.lit(0.0))
    )
