"""Removal of repeated byte strings against a brute-force version."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankloom.llm import suffix_dedup
from rankloom.llm.suffix_dedup import remove_repeats, repeated_windows, segments

SMALL = "/root/testdata/sf0.001"


def brute(texts: list[bytes], width: int) -> list[tuple]:
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def awkward() -> list[str | None]:
    r = random.Random(4)
    word = lambda n, letters="abcdef": "".join(r.choice(letters) for _ in range(n))
    passage = word(450)
    return [
        None, "", "short", "a" * 1500, "ab" * 900 + "x", "q" * 399, "z" + "a" * 401, word(900, "ab") * 2,
        *[word(200) + passage + word(300) for _ in range(30)], passage[:420], passage[10:], "é" * 300 + passage, "line\n" * 500,
    ]


@pytest.mark.parametrize("limit", [1_000, 3])
def test_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(suffix_dedup, "SHARD_SEGMENTS", limit)
    own = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    texts = own + awkward()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, digest string").repartition(5)
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs).collect()}
    expected = brute([(t or "").encode() for t in texts], 400)
    assert [rows[i] for i in range(len(texts))] == expected
    assert sum(e[1] for e in expected) > 20_000


def test_long_texts_are_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 500)
    r = random.Random(9)
    data = bytes(r.choice(b"abcd") for _ in range(5_000))
    shard, first, count, anchor = segments(np.frombuffer(data + data[1_000:1_700], np.uint8))
    assert int(count.sum()) == 5_700 - 399 and (np.diff(first) == count[:-1]).all()
    assert ((anchor >= first + count - 1) & (anchor <= first + 368)).all()


def test_column_wise_construction_finds_runs():
    r = random.Random(2)
    core = bytes(r.choice(b"xyz") for _ in range(60))
    pieces = [b"aa" + core + b"bb", b"c" + core, core + b"ddd", bytes(r.choice(b"xyz") for _ in range(50))]
    begin = np.array([-12, -11, -10, -10])
    lengths = np.array([len(p) for p in pieces])
    offsets = np.r_[0, np.cumsum(lengths)[:-1]]
    found = repeated_windows(np.zeros(4, np.int64), begin, begin + lengths, np.frombuffer(b"".join(pieces), np.uint8), offsets, 40)
    assert found == [(0, -10, 21), (1, -10, 21), (2, -10, 21)]


def test_copies_empty_table_and_text_output(spark):
    docs = spark.createDataFrame([(1, "m" * 50 + "n" * 500), (1, "m" * 50 + "n" * 500), (2, "tail")], "doc_id long, text string")
    rows = remove_repeats(docs, with_text=True).orderBy("doc_id").collect()
    assert [(r.n_removed, r.kept_text) for r in rows] == [(550, ""), (550, ""), (0, "tail")]
    assert remove_repeats(docs.where(F.lit(False))).count() == 0


def repetitive() -> list[str]:
    r = random.Random(6)
    word = lambda n: "".join(r.choice("abcdef ") for _ in range(n))
    line, block = word(90) + "\n", word(1_500)
    return [
        line * 400, word(700) + line * 6 + word(700), word(50) + line * 5, line * 4 + word(30), "x" * 9_000, "x" * 410,
        block + word(300) + block, word(200) + block[300:1_200] + word(200), block[:800] + "!" + block[:800] + line * 30,
    ]


@pytest.mark.parametrize("limit", [1_000, 1])
def test_repeats_within_a_text_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(suffix_dedup, "SHARD_SEGMENTS", limit)
    texts = repetitive()
    for some in (texts, texts[:1], texts[6:7], texts[1:5]):
        docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").repartition(3)
        rows = remove_repeats(docs).orderBy("doc_id").collect()
        assert [tuple(r)[1:] for r in rows] == brute([t.encode() for t in some], 400)


def test_a_line_said_over_and_over_is_not_a_row_each_time():
    line = "The same line, as a crawler finds it in a thousand places.\n"
    batch = pa.RecordBatch.from_pydict({"digest": [b"d"], "row_key": [1], "text": [line * 5_000]})
    run, _ = suffix_dedup._emit_segments(400)
    rows = [r for out in run(iter([batch])) for r in out.to_pylist()]
    assert len(rows) < 10
    of_runs = [r["windows"] for r in rows if r["shard"] is None]
    others = [r["windows"] for r in rows if not r["again"]]
    assert sum(of_runs) + sum(others) == len(line) * 5_000 - 399 and sum(others) < 1_000


def test_a_shard_of_many_texts_can_be_split_between_tasks(spark):
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abcdef ") for _ in range(n))
    passage = word(450)
    texts = [word(300) + passage + word(300) for _ in range(150)] + [t for t in (word(900) for _ in range(20)) for _ in range(2)]
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        spans = suffix_dedup.repeated_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
        assert len(spans.collect()) == 170
        plan = spans._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert re.search(r"SortMergeJoin\(skew=true\) \[shard#\d+L\], \[shard#\d+L\]", plan)
