import re
from collections import Counter

import pyarrow as pa

import rankloom.functions.counts as counts

TEXTS = [
    "A cat, a DOG and a cat", "cat dog cat dog cat dog", "", None, "x", "Ünder-ß naïve_x 2² ét no 東京 東", "a\nb\tcat  cat",
    "ends cat", "cat begins", "... --- !!", "_ __ _a", "O'Neil 𝒳𝒴 ΣΑΣ",
]


def items(text, bigrams):
    words = re.findall(r"\w{2,}" if bigrams else r"\w+", (text or "").lower())
    return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])] if bigrams else words)


def test_count_rows(spark):
    rows = [*enumerate(TEXTS), (None, "cat null key")]
    found = counts.count_rows(spark.createDataFrame(rows, "id int, t string").coalesce(1), ["id"], "t").collect()
    assert Counter({(r.id, r.value): r.n for r in found}) == Counter({(i, v): n for i, t in rows for v, n in items(t, True).items()})
    assert len(found) == len({(r.id, r.value) for r in found})


def test_shared_rows(spark):
    rows = [(i * 100 + j, a, b) for i, a in enumerate(TEXTS) for j, b in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "id int, q string, d string")
    for bigrams in (False, True):
        found = counts.shared_rows(df, ["id"], "q", "d", bigrams).collect()
        expected = {}
        for i, q, d in rows:
            q, d = items(q, bigrams), items(d, bigrams)
            expected.update({(i, v): (d[v], q[v], d.total()) for v in q.keys() & d.keys()})
        assert {(r.id, r.value): (r.n, r.query_n, r.doc_len) for r in found} == expected and len(found) == len(expected)


def test_slices_keep_all_rows(monkeypatch):
    monkeypatch.setattr(counts, "SLICE_BYTES", 8)
    batch = pa.RecordBatch.from_pydict({"a": ["12345", "", "1" * 20, "12", "34", "5678901"], "b": list("uvwxyz")})
    parts = list(counts._slices(iter([batch, batch.slice(0, 0)]), ["a", "b"]))
    assert len(parts) > 2 and pa.Table.from_batches(parts) == pa.Table.from_batches([batch])
    rows, words = counts._words(batch.slice(2, 3).column("a"))
    assert rows.tolist() == [0, 1, 2] and words.to_pylist() == ["1" * 20, "12", "34"]
