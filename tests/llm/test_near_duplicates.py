"""The pipeline's near-duplicate stage against fingerprints compared pair by pair in plain Python."""

import random

import xxhash

import corpus_pipeline

WORDS, BITS = 4, 4


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    shingles = [" ".join(words[i : i + WORDS]) for i in range(max(1, len(words) - WORDS + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_force(rows):
    """Whether each row (doc_id, text) is the smallest of its component: null ids last, then the order of the rows."""
    prints = [plain_fingerprint(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for j in range(len(rows)):
        for i in range(j):
            if (prints[i] ^ prints[j]).bit_count() <= BITS:
                root[find(j)] = find(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        name = (doc_id is None, doc_id or 0, i)
        least[find(i)] = min(least.get(find(i), name), name)
    return sorted((least[g][1], rows[least[g][2]][1] or "") for g in least)


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(5), "")
    assert found.columns == docs.columns
    return sorted((r.doc_id or 0, r.text or "") for r in found.collect())


def new_words(r, n):
    return ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(n)]


def test_edited_and_extended_texts(spark):
    """Variants on either side of the bound: some copies stay, since their fingerprints differ in more bits."""
    r, rows = random.Random(1), []
    for _ in range(40):
        text = new_words(r, 300)
        for edits in (0, 0, 1, 3, 8, 40):
            other = list(text)
            for k in r.sample(range(300), edits):
                other[k] = "edit%d" % k
            rows.append(" ".join(other))
        rows.append(" ".join(text + new_words(r, 30)))
        rows.append(" ".join(text).upper())
    rows = list(enumerate(r.sample(rows, len(rows))))
    true = brute_force(rows)
    assert 40 < len(true) < 240
    assert kept(spark, rows) == true


def test_hundreds_of_variants_of_a_text(spark):
    r = random.Random(3)
    base, rows = new_words(r, 404), []
    for k in range(400):
        text = list(base)
        for at in r.sample(range(404), r.randint(0, 9)):
            text[at] = base[(at + 7) % 404]
        rows.append((1_000 - k, " ".join(text)))
    true = brute_force(rows)
    assert len(true) < 200
    assert kept(spark, rows) == true


def test_null_ids_and_texts_without_words(spark):
    one, two = (" ".join(new_words(random.Random(k), 50)) for k in (4, 5))
    rows = [(None, one), (9, one), (9, one), (-3, one), (None, two), (None, two), (4, None), (5, ""), (3, " \n\t"), (None, None)]
    true = [(-3, one), (0, two), (3, " \n\t")]
    assert brute_force(rows) == sorted(true) and kept(spark, rows) == sorted(true)
    assert kept(spark, [(None, None)]) == [(0, "")] and kept(spark, []) == []
