import hashlib
import math
import random

import numpy as np
import pytest

import rankloom.llm.vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, parts=4, entries=256, rounds=4):
    """The codes by definition; rows are (vec_id, vector, label)."""
    good = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not good:
        return []
    width = max(1, -(-max(len(v) for _, v, _ in good) // parts)) * parts
    step = width // parts
    whole = [[math.floor(1024 * x) for x in v] + [0] * (width - len(v)) for _, v, _ in good]
    cut = [[w[p * step : (p + 1) * step] for p in range(parts)] for w in whole]
    order = sorted(range(len(good)), key=lambda i: (good[i][0] is None, good[i][0] or 0, good[i][1]))
    books = [[cut[i][p] for i in order[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            members = [[] for _ in books[p]]
            for c in cut:
                members[near(c[p], books[p])[1]].append(c[p])
            new.append([[sum(x) // len(m) for x in zip(*m)] if m else e for m, e in zip(members, books[p])])
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for (i, _, label), c in zip(good, cut):
        found = [near(c[p], books[p]) for p in range(parts)]
        out.append([i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label])
    top = (1 << 63) - 1
    total = {}
    for *_, e, label in out:
        total[label] = total.get(label, 0) + min(e, top)
    return sorted(((i, c, min(e, top), min(total[label], top), digest) for i, c, e, label in out), key=str)


def compress(spark, rows, schema=SCHEMA, **kw):
    return sorted((tuple(r) for r in vc.compress_vectors(spark.createDataFrame(rows, schema), **kw).collect()), key=str)


def drawn(seed, n, width, labels=3, spread=1.0):
    draw = random.Random(seed)
    return [(i, [draw.gauss(0, spread) for _ in range(width)], draw.choice([None, *range(labels)])) for i in range(n)]


def test_walsh_keeps_distances_and_counts_sign_changes():
    for size in (1, 2, 4, 8, 16, 32):
        rows = vc.walsh(np.eye(size, dtype=np.int64)).T
        assert [int((r[1:] != r[:-1]).sum()) for r in rows] == list(range(size))
    draw = np.random.default_rng(1)
    a, b = draw.integers(-2000, 2000, (2, 50, 13))
    assert (((vc.walsh(a) - vc.walsh(b)) ** 2).sum(1) == 16 * ((a - b) ** 2).sum(1)).all()


@pytest.mark.parametrize("width", [1, 3, 7, 16, 33, 70])
@pytest.mark.parametrize("high", [2, 1000, 1 << 40])
def test_nearest_equals_all_distances(width, high, monkeypatch):
    monkeypatch.setattr(vc, "TILE_CELLS", 500)
    draw = np.random.default_rng(width)
    parts, entries = draw.integers(-high, high, (90, width)), draw.integers(-high, high, (60, width))
    entries[40:] = entries[:20]  # ties
    parts[:10] = entries[25:35]
    all_distances = ((parts.astype(object)[:, None] - entries.astype(object)[None]) ** 2).sum(2)
    found, distance = vc.nearest(parts, entries)
    assert found.tolist() == [min(range(60), key=lambda i: (row[i], i)) for row in all_distances]
    assert distance.tolist() == all_distances.min(1).tolist()


def test_equals_the_definition(spark):
    rows = drawn(1, 400, 16)
    rows += [rows[3], rows[3], (None, rows[5][1], 1), (None, rows[6][1], None), (9_000, rows[7][1], 2)]
    rows += [(-5, None, 0), (-4, [None] * 16, 0), (-3, [1.0] * 15 + [float("nan")], 0), (-2, [float("-inf")] + [0.0] * 15, 0)]
    assert compress(spark, rows) == brute(rows)


def test_few_vectors_small_entries_and_hot_label(spark, monkeypatch):
    rows = [(i, v, 7) for i, v, _ in drawn(2, 60, 8)] + drawn(3, 5, 8)
    assert compress(spark, rows, entries=5, rounds=2) == brute(rows, entries=5, rounds=2)
    assert compress(spark, rows[:3]) == brute(rows[:3])
    assert compress(spark, rows[:1] * 4) == brute(rows[:1] * 4)


def test_odd_widths_count_as_filled_with_zeros(spark):
    rows = [(1, [1.0, 2.0, 3.0], None), (2, [], 1), (3, [0.5] * 10, 1), (4, [-0.001], 2)]
    assert compress(spark, rows) == brute(rows)
    assert compress(spark, [(1, [], 1)]) == brute([(1, [], 1)])


def test_components_beyond_longs(spark):
    rows = [(i, [x * 10.0 ** random.Random(i).randint(0, 45) for x in v], label) for i, v, label in drawn(4, 30, 8)]
    assert compress(spark, rows, entries=4) == brute(rows, entries=4)


def test_no_usable_rows_and_extra_columns(spark):
    assert compress(spark, []) == [] == compress(spark, [(1, None, 1), (2, [None], 2)])
    rows = [(*r, "x", 1, "y") for r in drawn(5, 20, 8)]
    schema = SCHEMA + ", code string, error long, label_key string"
    assert compress(spark, rows, schema) == brute([r[:3] for r in rows])


def test_hot_labels_are_spread(spark, monkeypatch):
    monkeypatch.setattr(vc, "largest", lambda df, keys, n: __import__("rankloom.operators.skew", fromlist=["x"]).largest(df, keys, n, 4))
    rows = [(i, v, None if i % 2 else 1) for i, v, _ in drawn(6, 50, 8)]
    assert compress(spark, rows, entries=8) == brute(rows, entries=8)
