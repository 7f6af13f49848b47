import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

import rankloom.llm.source_divergence as sd

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows, least=10, top=10):
    """The audit by its definition, over (text, lang, source) rows."""
    words = [(l or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(t or ""))) for t, l, s in rows]
    result = set()
    for lang in {l for l, _, _ in words}:
        own = [(s, w) for l, s, w in words if l == lang]
        in_docs = Counter(t for _, w in own for t in set(w))
        kept = sorted(t for t, n in in_docs.items() if n >= least)
        v, counts, everywhere = len(kept), defaultdict(Counter), Counter()
        for s, w in own:
            counts[s].update(t for t in w if in_docs[t] >= least)
        for c in counts.values():
            everywhere.update(c)

        def share(c):
            total = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * v) for t in kept}

        shares, q = {s: share(c) for s, c in counts.items()}, share(everywhere)
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in shares:
            pairs = [(-sum(gap(shares[s][t], shares[o][t]) for t in kept), o.encode(), "pair") for o in shares if o != s]
            terms = [
                (-gap(shares[s][t], q[t]), t.encode(), "term")
                for t in kept
                if counts[s][t] and shares[s][t] > q[t]
            ]
            for found in (sorted(pairs), sorted(terms)[:top]):
                for rank, (value, item, part) in enumerate(found, 1):
                    result.add((lang, s, part, item.decode(), -value, rank))
    return result


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def audit(spark, rows, **kw):
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    found = [tuple(r) for r in sd.audit_sources(docs, **kw).collect()]
    assert len(found) == len(set(found))
    return set(found)


def prose(seed, n, sources, langs=("en", "de")):
    draw = random.Random(seed)
    words = ["the", "The,", "sea", "Üb er", "a-b", "b", "x1y", "don't", "ÀÀ", "\x0b", "42"] + [f"w{chr(97 + i)}" for i in range(26)]
    return [
        (" ".join(draw.choices(words, k=draw.randint(0, 30))), draw.choice(langs), draw.choice(sources))
        for _ in range(n)
    ]


def test_equals_the_definition(spark):
    rows = prose(1, 300, ["s1", "s2", "s10", "é", "hot", "hot", "hot"])
    rows += [(None, None, None), ("", "en", "empty"), ("the sea", None, "s1"), ("...", "xx", "s1"), ("the", "xx", "s2")]
    assert audit(spark, rows) == brute(rows)


def test_tiles_and_small_memories_do_not_show(spark, monkeypatch):
    monkeypatch.setattr(sd, "TILE_TERMS", 3)
    rows = prose(2, 400, [f"s{i}" for i in range(70)], ("en",)) + [("the the The,", "en", "s0")] * 200
    assert audit(spark, rows, min_documents=3) == brute(rows, least=3)


def in_a_task(rows, least, held, monkeypatch):
    """Kept terms out of the three steps as tasks run them, all rows in one task each."""
    monkeypatch.setattr(sd, "HELD_COUNTS", held)
    monkeypatch.setattr(sd, "HELD_TERMS", held)
    monkeypatch.setattr(sd, "LONG_COUNTS", held)

    def sort(batches, *keys):
        found = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: [r[k] for k in keys])
        return [pa.RecordBatch.from_pylist(found[i : i + held], batches[0].schema) for i in range(0, len(found), held)]

    monkeypatch.setattr(sd.TaskContext, "get", classmethod(lambda c: type("T", (), {"partitionId": lambda s: 3})()))
    texts = pa.RecordBatch.from_pylist([{"text": (t or "").encode(), "lang": l or "", "source": s or ""} for t, l, s in rows])
    chunks = list(sd._count_chunks(least)(iter([texts])))
    terms = list(sd._cut_chunks(least)(iter(sort(chunks, "chunk", "lang"))))
    kept = list(sd._keep_terms(least)(iter(sort(terms, "lang", "term"))))
    return sum(c.num_rows for c in chunks), sorted(tuple(r.values()) for b in kept for r in b.to_pylist())


def test_what_a_task_holds_is_bounded_and_changes_nothing(monkeypatch):
    rows = prose(3, 300, ["s1", "s2", "é"])
    few, result = in_a_task(rows, 10, 1 << 30, monkeypatch)
    many, same = in_a_task(rows, 10, 7, monkeypatch)
    assert many > few and same == result and result


def test_counts_as_bytes():
    found = {b"": 1, b"s" * 300: 127, b"x": 128, "é".encode(): 1 << 40}
    written = b"".join(sd.write_count(s, n) for s, n in found.items())
    assert sd.read_counts(written) == found
    assert sd.read_counts(written * 3) == {s: 3 * n for s, n in found.items()}
    assert sd._times(written, 1) == written and sd.read_counts(sd._times(written, 5)) == {s: 5 * n for s, n in found.items()}


def test_documents_are_named_up_to_the_number_asked_for():
    one = sd._Sum(b"a" * 8, b"")
    one.add(b"a" * 8 + b"b" * 8, b"", 4)
    assert sorted(one.docs) == sorted(b"a" * 8 + b"b" * 8)
    one.add(b"c" * 8 + b"d" * 8, b"", 4)
    assert one.docs is None
    one.add(b"e" * 8, b"", 4)
    assert one.docs is None


@pytest.mark.parametrize("text", [b"", b" ", b"a", b"ab cd  ef\n" * 20, b"x" * 100 + b" y", b" " * 50])
def test_text_pieces_keep_every_chunk(text):
    parts = list(sd.text_pieces(text, 7))
    assert [c for p in parts for c in p.split()] == text.split()


def test_long_texts_repeated_rows_and_extra_columns(spark):
    long = "wa, wb. " * 400_000  # more than one piece
    rows = [(long, "en", "s1")] * 2 + [("wa", "en", "s2")] * 9 + [("wa-wa", "en", "s2")]
    docs = spark.createDataFrame(
        [(*r, 1, 2, 3) for r in rows], "text string, lang string, source string, term int, value int, rank int"
    )
    found = {tuple(r) for r in sd.audit_sources(docs).collect()}
    assert found == brute(rows)


def test_no_rows_and_no_kept_terms(spark):
    assert audit(spark, []) == set()
    rows = [("rare words", "en", s) for s in ("b", "a", "c")]
    assert audit(spark, rows) == {
        ("en", s, "pair", o, 0, 1 + sorted({"a", "b", "c"} - {s}).index(o)) for s in "abc" for o in "abc" if o != s
    }


def test_shares_are_exact_for_large_counts(spark):
    big = [(c, t, v) for c, t, v in [(0, 5, 2), (4 * 10**15, 9 * 10**15, 10**6), (9 * 10**15, 9 * 10**15, 1), (1, 1, 1)]]
    rows = spark.createDataFrame(big, "n long, total long, terms long").select("*", sd._billionths("n", "total", "terms").alias("p"))
    for r in rows.collect():
        assert r.p == 1 + 10**9 * (r.n + 2) // (r.total + 2 * r.terms)
