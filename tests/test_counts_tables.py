"""Row-level counts by numpy against plain Python, and that no lookup deals its rows out twice."""

import re

from pyspark.sql import functions as F

from rankloom.functions import counts as c
from rankloom.operators import tfidf
from rankloom.operators.skew import hot_keys, salted_lookup

WORDS = re.compile(r"\w+")
ROWS = [
    ("a", "What is a cat", "The cat: a CAT, is it?"),
    ("b", "", "none"),
    ("c", "Éa — çb…éa", "éa ﬁ çb 日本 日本語"),
    ("d", None, None),
    ("e", "x_1 y²", "x_1 … y² ½"),
]


def words(text):
    return WORDS.findall((text or "").lower())


def grams(text):
    long = [w for w in words(text) if len(w) > 1]
    return [*long, *[f"{a} {b}" for a, b in zip(long, long[1:])]]


def frame(spark):
    return spark.createDataFrame(ROWS, "id string, question string, document string")


def test_overlap(spark):
    found = {r.id: tuple(r)[1:] for r in c.with_overlap(frame(spark), "question", "document").drop("question", "document").collect()}
    assert found == {i: (len({*words(q)} & {*words(d)}), len(words(q)), len(words(d))) for i, q, d in ROWS}


def test_word_lists(spark):
    found = {r.id: (sorted(r.terms), r.length) for r in c.word_lists(frame(spark), ["id"], "document").collect()}
    assert found == {i: (sorted({*words(d)}), len(words(d))) for i, _, d in ROWS}


def test_total_rows(spark, monkeypatch):
    monkeypatch.setattr(c, "SLICE_BYTES", 20)
    texts = spark.createDataFrame([(d, n) for n, (_, _, d) in enumerate(ROWS, 1)], "text string, weight long")
    want = {}
    for n, (_, _, d) in enumerate(ROWS, 1):
        for g in {*grams(d)}:
            df, own = want.get(g, (0, 0))
            want[g] = (df + n, own + 1)
    assert {r.gram: (r.df, r.n_texts) for r in tfidf.gram_totals(texts).collect()} == want


def test_keys_stand_for_items(spark):
    """The same item has the same bits whatever else its slice holds; others have others."""
    texts = ["cat dog", "dog cat", "cat cat dog bird", "zebra cat dog", "bird"]
    named, keyed = {}, {}
    for i, text in enumerate([*texts, " ".join(texts)]):
        df = spark.createDataFrame([(i, text)], "id int, text string")
        named[i] = {r.value: r.n for r in c.count_rows(df, ["id"], "text").collect()}
        keyed[i] = sorted((r.value_a, r.value_b, r.n) for r in c.count_rows(df, ["id"], "text", keyed=True).collect())
        assert sorted(n for *_, n in keyed[i]) == sorted(named[i].values())
    items = {g for some in named.values() for g in some}
    assert len({k[:2] for some in keyed.values() for k in some}) == len(items)
    assert [k[:2] for k in keyed[4]][0] in {k[:2] for k in keyed[2]}


def test_lookup_deals_rows_out_once(spark):
    rows = spark.range(3000).select(F.col("id").alias("n"), F.when(F.col("id") < 2000, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    table = rows.select("k").distinct().select("k", F.length("k").alias("size"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = salted_lookup(rows, table, ["k"], spread="n", how="inner", hot=hot_keys(rows, ["k"], target=100))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.agg(F.count("*"), F.sum("size"), F.count_distinct("n")).first()[:] == (3000, 2000 * 3 + 1000 * 4, 3000)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("SortMergeJoin") == 1


def test_lookup_joins_small_partitions_by_hash(spark):
    name = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    kept = {k: spark.conf.get(k) for k in (name, "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.unset(name)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(2000).select(F.col("id").alias("n"), (F.col("id") % 500).alias("k"))
        table = spark.range(600).select(F.col("id").alias("k"), (F.col("id") * 2).alias("twice"))
        joined = salted_lookup(rows, table, ["k"], spread="n", how="inner")
        assert {(r.n, r.twice) for r in joined.collect()} == {(i, i % 500 * 2) for i in range(2000)}
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan.split("Initial Plan")[0]
        spark.conf.set(name, "1b")
        salted_lookup(rows, table, ["k"], spread="n")
        assert spark.conf.get(name) == "1b"
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
