"""Decontamination, personal data, language, fingerprints: against brute force or held-out labels."""

import hashlib
import random
import re
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from rankloom.llm import decontamination, langid, pii, shared, simhash

SMALL = "/root/testdata/sf0.001"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


# --- benchmark windows ---------------------------------------------------------------

BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_overlap(docs, items):
    windows = {}
    for item, text in items:
        w = BENCH_WORD.findall(lowered(text))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(item)
    lengths = {len(w) for w in windows}
    for doc, text in docs:
        w, hit, found = BENCH_WORD.findall(lowered(text)), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        ids = ",".join(sorted(str(x) for x in found if x is not None))
        yield doc, (len(w), len(hit), len({x for x in found if x is not None}), hashlib.sha256(ids.encode()).hexdigest(), bool(hit))


@pytest.mark.parametrize("block", [200_000, 600])
def test_benchmark_windows(spark, block):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").limit(80).collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    items += [(901, "Über-Cool"), (902, "x"), (903, None), (904, "..."), (None, "zz yy"), (items[0][0], items[1][1]), (77, items[2][1])]
    docs += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "über cool X"), (10**6 + 3, "zz yy"), (10**6 + 4, "a " * 400 + items[3][1] + " b" * 900 + " " + items[4][1]), (10**6 + 5, "xü x")]
    left = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    right = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.benchmark_overlap(left, right, keep_text=False, block=block)
    rows = {r[0]: tuple(r)[1:] for r in decontamination.overlap_digest(found).collect()}
    expected = dict(brute_overlap(docs, items))
    assert rows == expected and sum(e[4] for e in expected.values()) >= 5


@pytest.mark.parametrize("piece", [1 << 21, 300])
def test_long_texts_come_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(decontamination, "PIECE_BYTES", piece)
    monkeypatch.setattr(decontamination, "pieces", lambda offsets: shared.pieces(offsets, piece))
    r = random.Random(5)
    words = [f"w{i}é" for i in range(300)]
    item = [r.choice(words) for _ in range(25)]
    text = " ".join(r.choice(words) for _ in range(900))
    docs = [(0, text), (1, text + " " + " ".join(item) + ". " + text), (2, ""), (3, " ".join(item * 40)), (4, "x" * 2_000)]
    rows = list(decontamination._windows_of_text(" ".join(item), 10))
    windows = decontamination.Windows([("7", w) for w in rows], 3)
    counts = {n: np.arange(len(k)) for n, k in windows.by_size().items()}
    table = pa.table({"doc_id": [d for d, _ in docs], "__text": [t for _, t in docs], "hit_runs": pa.nulls(5, decontamination._RUNS), "hit_items": pa.nulls(5, pa.list_(pa.string()))})
    run = decontamination._scan(types.SimpleNamespace(value=(windows, windows.prefixes(counts))), 9, ["doc_id"], "__text")
    got = [x for b in run(table.to_batches()) for x in b.to_pylist()]
    for (_, expected), x in zip(brute_overlap(docs, [(7, " ".join(item))]), got):
        assert (x["n_words"], sum(y["end"] - y["first"] for y in x["hit_runs"]), len(x["hit_items"])) == expected[:3]


def test_benchmark_without_items(spark):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    empty = spark.createDataFrame([], "item_id long, text string")
    row = decontamination.benchmark_overlap(docs, empty).first()
    assert row.n_words == 3 and row.hit_runs == [] and row.text == "some words here"
    assert decontamination.benchmark_overlap(docs.where("false"), empty).count() == 0


# --- personal data -------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = (
                kind == "email"
                or kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))
                or kind == "card" and 16 <= len(digits) <= 19 and pii.luhn(digits)
                or kind == "phone" and 8 <= len(digits) <= 15
            )
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans(spark):
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    texts += [
        None, "", "a@b.cd@e.f x@y", "a@b.c-d.e_x@y.zz", "@@a@.b a@b..c", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4 9999.1.2.3.4",
        "+1 (234) 567-8901 +12 +1-", "é 4111 1111 1111 1111 é", "+1 2 3" * 300, "9" * 5_000, "x" * 9_000 + "@b.c",
    ]
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, pii_spans string")
    rows = {r.doc_id: r for r in pii.pii_digest(pii.with_pii(docs)).collect()}
    for i, text in enumerate(texts):
        spans = brute_spans(text)
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert rows[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), text
        assert rows[i].n_email == sum(k == "email" for k, *_ in spans)
        assert set(listed.split(",")) <= set(rows[i].spans.split(",")) or not spans


def test_checksums_context_and_redaction():
    text = "IBAN GB82 WEST 1234 5698 7654 32 AND card 378282246310005, number 378282246310006, ssn 123-45-6789"
    spans = pii.find_spans(text)
    assert [(s.kind, text[s.start : s.end]) for s in spans] == [
        ("card", "378282246310005"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("ssn", "123-45-6789"),
    ]
    assert not [s for s in pii.find_spans("x 123-45-6789 y 378282246310005") if s.kind in ("ssn", "card")]
    assert pii.redact(text, spans).startswith("IBAN [IBAN] AND card [CARD], number 378")
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_pii_keeps_null_and_empty(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a@b.cc")], "doc_id long, text string")
    assert [r.pii_redacted for r in pii.with_pii(docs).orderBy("doc_id").collect()] == [None, "", "[EMAIL]"]
    assert pii.with_pii(docs.where("false")).count() == 0


# --- language ------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    key = F.col("doc_id")
    model = langid.fit(docs.where(~langid.held_out(key)), "text", "lang", key)
    rows = langid.with_language(docs, model, keep=["doc_id", "lang"]).where(langid.held_out(key)).collect()
    assert len(rows) > 250 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    some = spark.createDataFrame(
        [(1, None), (2, ""), (3, "12 ... 7"), (4, "…«»"), (5, "the of and that with " * 4 + "der die und nicht ein " * 2)],
        "doc_id long, text string",
    ).withColumn("score", F.lit("clash"))
    found = {r.doc_id: r for r in langid.with_language(some, model).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3, 4)] == ["und"] * 4 and found[5].lang_pred == "en"
    assert [(s.lang, s.words) for s in found[5].lang_spans] == [("en", 20), ("de", 10)]
    assert {r.doc_id for r in docs.where(langid.held_out(key)).collect()} == {r.doc_id for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}


@pytest.mark.parametrize("n", [1, 127, 128, 130, 256, 300])
def test_viterbi_of_many_languages(n):
    scores = np.zeros((7, n), np.float32)
    scores[:4, n - 1], scores[4:, n // 2] = 9, 9
    assert langid.viterbi(scores, np.array([0, 6, 7]), 2.0).tolist() == [n - 1] * 4 + [n // 2] * 3


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(3)
    scores = rng.normal(0, 3, (9, 3)).astype(np.float32)
    first = np.array([0, 4, 4, 9])
    labels = langid.viterbi(scores, first, 2.0)
    for a, b in zip(first, first[1:]):
        own = scores[a:b]
        value = lambda p: sum(own[i, x] for i, x in enumerate(p)) - 2.0 * sum(x != y for x, y in zip(p, p[1:]))
        paths = np.stack(np.meshgrid(*[range(3)] * (b - a), indexing="ij"), -1).reshape(-1, b - a) if b > a else []
        assert b == a or value(labels[a:b]) == pytest.approx(max(map(value, paths)), abs=1e-4)


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs, "text", "lang", F.col("doc_id"))
    assert langid.with_language(docs, model).first().lang_pred == "und"
    russian = spark.createDataFrame([(1, "привет мир слово дело", "ru"), (2, "hello world word deed", "en")], "doc_id long, text string, lang string")
    model = langid.fit(russian, "text", "lang", F.col("doc_id"))
    asked = spark.createDataFrame([(1, "слова мира"), (2, "worlds")], "doc_id long, text string")
    assert [r.lang_pred for r in langid.with_language(asked, model).orderBy("doc_id").collect()] == ["ru", "en"]


# --- fingerprints --------------------------------------------------------------------


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


def test_simhash_components(spark):
    r = random.Random(1)
    base = "the quick brown fox jumps over the lazy dog and runs far away from here today".split()
    docs = [tuple(x) for x in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(10**6 + i, " ".join(base[: i % 7 + 1] * (i % 5 + 1) + [str(i % 13)] * (i % 3))) for i in range(200)]
    docs += [(10**6 + 300, None), (10**6 + 301, ""), (10**6 + 302, " \n")]
    for group in range(6):  # near copies: one word more each
        text = " ".join(r.choice(base) for _ in range(80))
        docs += [(2 * 10**6 + 100 * group + i, f"{text} {i}") for i in range(40)]
    found = {x.doc_id: x for x in simhash.simhash_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    prints = [brute_fingerprint(t) for _, t in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    tops, ids = roots(len(docs), links), [d for d, _ in docs]
    least = {}
    for i, top in enumerate(tops):
        least[top] = min(least.get(top, ids[i]), ids[i])
    assert {d: (f"{p:016x}", least[top]) for d, p, top in zip(ids, prints, tops)} == {d: (x.fingerprint, x.component_id) for d, x in found.items()}
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("limit,segments", [(4, 5), (7, 8)])
def test_pigeonring_loses_no_link(spark, limit, segments):
    r = random.Random(limit)
    fps = [r.getrandbits(64) for _ in range(300)]
    for f in fps[:120]:
        for _ in range(3):
            fps.append(f ^ sum(1 << b for b in r.sample(range(64), r.randint(1, limit + 2))))
    fps = sorted(set(fps))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    index = {f: i for i, f in enumerate(fps)}
    got = [(index[x.a % (1 << 64)], index[x.b % (1 << 64)]) for x in simhash.fingerprint_links(df, limit, segments).collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= limit for a, b in got)
    true = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= limit]
    assert roots(len(fps), got) == roots(len(fps), true)


def test_components_of_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    found = simhash.components(spark.createDataFrame(chain, "a long, b long"))
    assert {tuple(r) for r in found.collect()} == {(i, 0) for i in range(1, 51)} | {(100 + i, 100) for i in range(1, 40)}
