"""Benchmark passages in documents: a prefix-filtered set join of item-sized windows.

A window (ten consecutive words of an item, or all of a shorter item) occurs in a
document only if each of its shingles does. So one shingle of each window, the rarest
in the documents, is a sufficient prefix: shingles are counted over all documents, put
in order of rarity, and only that first one is joined. Its place in the window fixes
where the window would have to begin; it must fit into the document (the bounds on
position and length), and then all its words are compared.

The benchmark is the query set: it is read in blocks of at most ``BLOCK_WINDOWS``
windows, and each block is sent to all tasks; documents are scanned in place and never
shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.shared import PIECE_BYTES, flat_bytes, pieces, staged, with_own_text

WINDOW_WORDS = 10
SHINGLE_WORDS = 3
BLOCK_WINDOWS = 200_000
_BASE = 0x9E3779B97F4A7C15
_TABLE_BITS = 20

# Bytes of words once A-Z are lowered: digits, a-z and all of non-ASCII characters.
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_IN_WORD = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n + 1:
        size = max(n + 1, PIECE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of some texts: hash, begin, end (bytes), and where the words of each text begin (n + 1)."""
    lower = _LOWER[data]
    inside = _IN_WORD[lower]
    edge = np.zeros(len(data) + 1, bool)
    if len(data):
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[0], edge[-1] = inside[0], inside[-1]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        touching = inner[inside[inner] & inside[inner - 1]]  # a word that ends where the next text begins
    else:
        touching = np.zeros(0, np.int64)
    at = np.flatnonzero(edge)
    if len(touching):
        at = np.sort(np.concatenate([at, np.unique(touching), np.unique(touching)]))
    begin, end = at[0::2], at[1::2]
    up, down = _power_tables(len(data))
    with np.errstate(over="ignore"):
        total = np.r_[np.uint64(0), np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * down[: len(data)], dtype=np.uint64)]
        h = (total[end] - total[begin]) * up[end]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h, begin, end, np.searchsorted(begin, offsets)


def _shingles(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place on."""
    with np.errstate(over="ignore"):
        h = words[: len(words) - n + 1].copy() if len(words) >= n else words[:0]
        for k in range(1, n):
            h = h * np.uint64(_BASE) + words[k : len(words) - n + 1 + k]
        return h ^ (h >> np.uint64(31))


class Windows:
    """A block of windows: their words, the items they come from, and their shingles."""

    def __init__(self, rows: list[tuple[str | None, list[bytes]]], shingle: int):
        by_words: dict[tuple[bytes, ...], set[str]] = {}
        for item, words in rows:
            by_words.setdefault(tuple(words), set()).update([] if item is None else [item])
        self.words = list(by_words)
        self.items = [sorted(by_words[w]) for w in self.words]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.hashes = np.zeros((len(self.words), int(self.lengths.max())), np.uint64)
        known: dict[bytes, np.uint64] = {}
        vocabulary = sorted(set(chain.from_iterable(self.words)))
        flat = np.frombuffer(b" ".join(vocabulary), np.uint8)
        h, *_ = word_hashes(flat, np.array([0, len(flat)]))
        known = dict(zip(vocabulary, h))
        for i, w in enumerate(self.words):
            self.hashes[i, : len(w)] = [known[x] for x in w]
        self.sizes = np.minimum(self.lengths, shingle)
        self.shingles = [_shingles(self.hashes[i, : self.lengths[i]], int(self.sizes[i])) for i in range(len(self.words))]

    def by_size(self) -> dict[int, np.ndarray]:
        """Different shingles, sorted, for each number of words in use."""
        out: dict[int, list[np.ndarray]] = {}
        for s, size in zip(self.shingles, self.sizes):
            out.setdefault(int(size), []).append(s)
        return {size: np.unique(np.concatenate(x)) for size, x in out.items()}

    def prefixes(self, counts: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By shingle size, sorted by shingle: the rarest shingle of each window, the window, the place in it."""
        known, found = self.by_size(), {}
        for i, (s, size) in enumerate(zip(self.shingles, self.sizes)):
            n = counts[int(size)][np.searchsorted(known[int(size)], s)]
            k = int(np.lexsort((s, n))[0])
            found.setdefault(int(size), []).append((int(s[k]), i, k))
        out = {}
        for size, rows in found.items():
            rows.sort()
            keys, windows, places = zip(*rows)
            out[size] = (np.array(keys, np.uint64), np.array(windows, np.int64), np.array(places, np.int64))
        return out


def _among(values: np.ndarray, table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the values that are among the sorted keys; the table of low bits sorts out most of them."""
    at = np.flatnonzero(table[(values & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)])
    found = np.searchsorted(keys, values[at])
    found[found == len(keys)] = 0
    return at[keys[found] == values[at]]


def _table(keys: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << _TABLE_BITS, bool)
    table[(keys & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)] = True
    return table


def _text_pieces(data: np.ndarray, offsets: np.ndarray, overlap: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """(first row, end row, bytes, offsets, words skipped) of bounded size.

    A text above the limit comes in several pieces, cut between words; each but the first
    begins ``overlap`` words early, and the last number is the text's words before it."""
    for first, last in pieces(offsets):
        part, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        if len(part) <= 2 * PIECE_BYTES:
            yield first, last, part, at, 0
            continue
        begin, skipped = 0, 0
        while begin < len(part):
            end = min(len(part), begin + PIECE_BYTES)
            while end < len(part) and _IN_WORD[_LOWER[part[end]]]:
                end += 1
            piece = part[begin:end]
            yield first, last, piece, np.array([0, len(piece)]), skipped
            if end == len(part):
                break
            _, starts, _, _ = word_hashes(piece, np.array([0, len(piece)]))
            back = min(overlap, len(starts) - 1) if len(starts) else 0
            skipped += len(starts) - back
            begin = begin + int(starts[len(starts) - back]) if back > 0 else end


def _count_shingles(shared, overlap_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        counts = {size: np.zeros(len(keys), np.int64) for size, keys in known.items()}
        tables = {size: _table(keys) for size, keys in known.items()}
        for batch in batches:
            data, offsets = flat_bytes(batch.column(0))
            # A text in several pieces may count a shingle at a cut twice or not at all: only the order depends on it.
            for *_, part, at, _ in _text_pieces(data, offsets, 0):
                words, *_ = word_hashes(part, at)
                for size, keys in known.items():
                    s = _shingles(words, size)
                    hit = _among(s, tables[size], keys)
                    np.add.at(counts[size], np.searchsorted(keys, s[hit]), 1)
        for size, n in counts.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), size, np.int32)), pa.array(some), pa.array(n[some])], ["size", "shingle", "n"])

    return run


_RUNS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def _hits(windows: Windows, prefixes, tables, data: np.ndarray, at: np.ndarray):
    """Words in a piece by text, and (text, first word in it, window) of all windows that occur."""
    words, begin, end, first_word = word_hashes(data, at)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(first_word))
    found = []
    lower = None
    for size, (keys, ids, places) in prefixes.items():
        s = _shingles(words, size)
        hit = _among(s, tables[size], keys)
        if not len(hit):
            continue
        low, high = np.searchsorted(keys, s[hit], "left"), np.searchsorted(keys, s[hit], "right")
        many = high - low
        pos = np.repeat(hit, many)
        pick = np.repeat(low, many) + np.arange(len(pos)) - np.repeat(np.cumsum(many) - many, many)
        window = ids[pick]
        start, length = pos - places[pick], windows.lengths[window]
        text = owner[pos]
        fits = (start >= first_word[text]) & (start + length <= first_word[text + 1])
        start, window, text = start[fits], window[fits], text[fits]
        same = np.ones(len(start), bool)
        for k in range(windows.hashes.shape[1]):
            todo = np.flatnonzero(same & (windows.lengths[window] > k))
            same[todo] = words[start[todo] + k] == windows.hashes[window[todo], k]
        for p, w, t in zip(start[same].tolist(), window[same].tolist(), text[same].tolist()):
            if lower is None:
                lower = _LOWER[data].tobytes()
            own = windows.words[w]
            if all(lower[begin[p + k] : end[p + k]] == x for k, x in enumerate(own)):
                found.append((t, p - int(first_word[t]), w))
    return np.diff(first_word), found


def _scan(shared, overlap: int, keep: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, prefixes = shared.value
        tables = {size: _table(keys) for size, (keys, *_) in prefixes.items()}
        for batch in batches:
            data, offsets = flat_bytes(batch.column(text))
            runs = [[(r["first"], r["end"]) for r in x or ()] for x in batch.column("hit_runs").to_pylist()]
            items = [set(x or ()) for x in batch.column("hit_items").to_pylist()]
            n_words = np.zeros(batch.num_rows, np.int64)
            for first, last, part, at, skipped in _text_pieces(data, offsets, overlap):
                own, found = _hits(windows, prefixes, tables, part, at)
                n_words[first:last] = skipped + own
                for row, word, window in found:
                    runs[first + row].append((skipped + word, skipped + word + len(windows.words[window])))
                    items[first + row].update(windows.items[window])
            merged = [[{"first": f, "end": e} for f, e in _merged(x)] for x in runs]
            arrays = [batch.column(c) for c in keep]
            arrays += [pa.array(n_words), pa.array(merged, _RUNS), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, keep + ["n_words", "hit_runs", "hit_items"])

    return run


def _windows_of_text(text: str, size: int) -> Iterator[list[bytes]]:
    data = np.frombuffer(text.encode(), np.uint8)
    _, begin, end, _ = word_hashes(data, np.array([0, len(data)]))
    lower = _LOWER[data].tobytes()
    words = [lower[b:e] for b, e in zip(begin.tolist(), end.tolist())]
    for k in range(max(1, len(words) - size + 1) if words else 0):
        yield words[k : k + size]


def _windows_of(benchmark: DataFrame, item_id: str, text: str, size: int) -> Iterator[tuple[str | None, list[bytes]]]:
    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    for row in rows.toLocalIterator():
        for words in _windows_of_text(row["text"], size):
            yield row["item"], words


def benchmark_overlap(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW_WORDS,
    shingle: int = SHINGLE_WORDS,
    block: int = BLOCK_WINDOWS,
    keep_text: bool = True,
) -> DataFrame:
    """All columns of ``docs`` (its text only if asked) plus ``n_words``, ``hit_runs`` (merged word
    ranges that windows occur in) and ``hit_items`` (sorted different ids, as strings).

    Null and empty texts have no words; an item without words has no window; an item
    without an id marks words but is not listed; equal items are all listed; repeated
    documents are judged each on its own; an empty benchmark hits nothing. Input columns
    with the names of the results are replaced.
    """
    spark: SparkSession = docs.sparkSession
    keep = [c for c in docs.columns if c not in ("n_words", "hit_runs", "hit_items") and (keep_text or c != text)]
    none = (
        F.lit(None).cast("array<struct<first:bigint,end:bigint>>").alias("hit_runs"),
        F.lit(None).cast("array<string>").alias("hit_items"),
    )
    rows, name, fields = with_own_text(docs, keep, text, *none)
    results = "n_words long, hit_runs array<struct<first:bigint,end:bigint>>, hit_items array<string>"
    source, held, n_blocks = _windows_of(benchmark, item_id, item_text, window), [], 0
    done = False
    while not done:
        held = []
        for one in source:
            held.append(one)
            if len(held) == block:
                break
        done = len(held) < block
        if not held and n_blocks:
            break
        if n_blocks:  # one block at a time is in memory
            rows = staged(rows, "decontamination-block").drop("n_words")
        windows = Windows(held or [(None, [b"\xff"])], shingle)  # a word that no UTF-8 text has
        known = windows.by_size()
        counted = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(
            _count_shingles(spark.sparkContext.broadcast(known), window), "size int, shingle long, n long"
        )
        counts = {size: np.zeros(len(keys), np.int64) for size, keys in known.items()}
        # Bounded by the block: a row for each of its different shingles.
        for r in counted.groupBy("size", "shingle").agg(F.sum("n").alias("n")).toLocalIterator():
            counts[r["size"]][r["shingle"]] = r["n"]
        shared = spark.sparkContext.broadcast((windows, windows.prefixes(counts)))
        # Another block needs the text again; the last one lets go of what is not kept.
        carried = keep if done or name in keep else [*keep, name]
        extra = "" if carried == keep else f"{name} string, "
        rows = rows.mapInArrow(_scan(shared, window - 1, carried, name), f"{fields}{extra}{results}")
        n_blocks += 1
    return rows.drop("__text")


def overlap_digest(found: DataFrame) -> DataFrame:
    """doc_id, word and hit counts, number and digest of the items, and the decision."""
    hit = F.aggregate("hit_runs", F.lit(0).cast("long"), lambda total, r: total + r["end"] - r["first"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("hit_items")), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
