"""Counts of words and grams of each row's texts, as one row per row and item.

Spark lower-cases the texts and finds the word characters of those that are not ASCII; the words
of a slice of rows are then cut, numbered and counted together as arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are counted at once; a longer text makes a slice of its own.
SLICE_BYTES = 4 << 20

#: Characters above 127 that belong to no word; those below are told apart as bytes.
NO_WORD_ABOVE = r"[^\x00-\x7F\p{L}\p{N}]+"

_IS_WORD = np.array([b > 127 or chr(b).isalnum() or chr(b) == "_" for b in range(256)])


def spaced_words(text: Column) -> Column:
    """Lower-cased text in which every character above 127 belongs to a word; null counts as ''."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    ascii_only = F.octet_length(lower) == F.char_length(lower)
    return F.when(ascii_only, lower).otherwise(F.regexp_replace(lower, NO_WORD_ABOVE, " "))


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row of each word, word) of an array of spaced words."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = (ends - ends[0]).astype(np.int64)
    inside = np.append(_IS_WORD[data], False)
    before = np.insert(inside[:-1], 0, False)
    before[ends[:-1]] = False  # a text does not go on in the next one
    starts = np.flatnonzero(inside & ~before)
    kept = np.cumsum(inside[:-1], dtype=np.int32)
    # Each word begins with a kept byte, which its running number counts already.
    offsets = np.append(kept[starts] - 1, kept[-1:] if len(kept) else 0).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside[:-1]]))
    return np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, ends))), words


def _items(columns: list[pa.Array], bigrams: bool) -> tuple[list[tuple[np.ndarray, np.ndarray]], pa.Array, int]:
    """(row, item number) of all items of each column, the different words, and their number.

    With ``bigrams``, words of one character are gone and a pair of neighbours is an item, too."""
    cut = [_words(c) for c in columns]
    encoded = pa.concat_arrays([w for _, w in cut]).dictionary_encode()
    words, code = encoded.dictionary, encoded.indices.to_numpy().astype(np.int64)
    found, at, n = [], 0, max(1, len(words))
    long = pc.greater_equal(pc.utf8_length(words), 2).to_numpy(zero_copy_only=False)
    for row, own in cut:
        item, at = code[at : at + len(own)], at + len(own)
        if bigrams:
            on = long[item]
            row, item = row[on], item[on]
            near = np.flatnonzero(row[1:] == row[:-1])
            row, item = np.concatenate([row, row[near]]), np.concatenate([item, n + item[near] * n + item[near + 1]])
        found.append((row, item))
    return found, words, n


def _texts(item: np.ndarray, words: pa.Array, n: int) -> pa.Array:
    """The items themselves."""
    single = item < n
    first, second = np.where(single, item, item // n - 1), np.where(single, 0, item % n)
    both = pc.binary_join_element_wise(words.take(pa.array(first)), words.take(pa.array(second)), " ")
    return pc.if_else(pa.array(single), words.take(pa.array(first)), both)


def _different(x: np.ndarray) -> np.ndarray:
    """The different numbers in order; by sorting, which takes a third of the time of ``np.unique`` here."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers in order and how often each occurs."""
    x = np.sort(x)
    starts = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.arange(0)
    return x[starts], np.diff(np.append(starts, len(x)))


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _keys(item: np.ndarray, words: pa.Array, n: int) -> list[pa.Array]:
    """128 bits of each item, in two columns: those of the word, or mixed from those of both words."""
    digests = (hashlib.blake2b(w, digest_size=16).digest() for w in words.cast(pa.binary()).to_pylist())
    own = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    pairs = np.flatnonzero(item >= n)
    keys = own[np.where(item < n, item, item // n - 1)]
    keys[pairs] = _mixed(_mixed(keys[pairs] + np.uint64(0x9E3779B97F4A7C15)) + own[item[pairs] % n])
    return [pa.array(np.ascontiguousarray(keys[:, i]).view(np.int64)) for i in (0, 1)]


def _named(item: np.ndarray, words: pa.Array, n: int, keyed: bool) -> list[pa.Array]:
    return _keys(item, words, n) if keyed else [_texts(item, words, n)]


def _slices(batches: Iterator[pa.RecordBatch], texts: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = np.cumsum(sum(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in texts))
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + SLICE_BYTES, "right")))
            yield batch.slice(at, to - at)
            at = to


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


#: Columns that name an item: its text, or its 128 bits.
VALUE, KEYS = ["value"], ["value_a", "value_b"]


def _value_fields(keyed: bool) -> str:
    return "value_a bigint, value_b bigint" if keyed else "value string"


def count_rows(df: DataFrame, keep: list[str], text: str, bigrams: bool = True, keyed: bool = False) -> DataFrame:
    """(kept columns, value, n): the items of each row's text and how often each occurs there.

    With ``keyed``, value_a and value_b, 128 bits of the item, stand for its text."""
    fields, value = _fields(df.select(*keep)), KEYS if keyed else VALUE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, ["__text"]):
            [(row, item)], words, n = _items([part.column("__text")], bigrams)
            if not len(row):
                continue
            width = n * (n + 1)
            key, count = _counted(row * width + item)
            held = part.select(keep).take(pa.array(key // width))
            yield pa.RecordBatch.from_arrays([*held.columns, *_named(key % width, words, n, keyed), pa.array(count)], [*keep, *value, "n"])

    return df.select(*keep, spaced_words(F.col(text)).alias("__text")).mapInArrow(run, f"{fields}, {_value_fields(keyed)}, n bigint")


#: Parts that items are dealt into by their bits. A part is merged at once, so it holds this share of all counts.
PARTS = 2048

#: Items of a part, one a line, and their counts as 64-bit integers: rows that Spark moves as they are.
TOTALS = "part int, items string, df binary, n_texts binary"


def _joined(items: pa.Array, counts: list[np.ndarray], ends: np.ndarray) -> list[pa.Array]:
    """The columns of ``TOTALS`` but the first, a row for what lies between two ends."""
    lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), items), "\n")
    offsets = pa.py_buffer((ends * 8).astype(np.int32))
    numbers = [pa.py_buffer(np.ascontiguousarray(c, dtype="<i8")) for c in counts]
    return [lines, *[pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, offsets, n]) for n in numbers]]


def total_lists(df: DataFrame, weight: str, text: str) -> DataFrame:
    """(part, items, df, n_texts): the items of all texts, bigrams included, the sum of ``weight`` over the texts
    that hold each, and their number, as one row per part for each slice of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, ["__text"]):
            [(row, item)], words, n = _items([part.column("__text")], True)
            if not len(row):
                continue
            # Once per text, by item.
            key = _different(item * part.num_rows + row)
            own, row = key // part.num_rows, key % part.num_rows
            starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            code, n_texts = own[starts], np.diff(np.append(starts, len(own)))
            sums = np.add.reduceat(part.column("__weight").to_numpy(zero_copy_only=False)[row], starts)
            place = (_keys(code, words, n)[0].to_numpy() & (PARTS - 1)).astype(np.int16)
            order = np.argsort(place, kind="stable")
            sizes = np.bincount(place, minlength=PARTS)
            found = np.flatnonzero(sizes)
            ends = np.insert(np.cumsum(sizes[found]), 0, 0)
            columns = _joined(_texts(code[order], words, n), [sums[order], n_texts[order]], ends)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), *columns], ["part", "items", "df", "n_texts"])

    rows = df.select(F.col(weight).cast("bigint").alias("__weight"), spaced_words(F.col(text)).alias("__text"))
    return rows.mapInArrow(run, TOTALS)


def _merged(part: pa.Table) -> list[pa.Array]:
    """The different items of one part, with the sums of df and n_texts."""
    items = pc.list_flatten(pc.split_pattern(part.column("items"), "\n"))
    counts = [np.frombuffer(b"".join(part.column(c).to_pylist()), "<i8") for c in ("df", "n_texts")]
    flat = pa.table([items, *counts], ["items", "df", "n_texts"])
    sums = flat.group_by("items", use_threads=False).aggregate([("df", "sum"), ("n_texts", "sum")])
    return [sums.column(c).combine_chunks() for c in ("items", "df_sum", "n_texts_sum")]


def merged_lists(lists: DataFrame) -> DataFrame:
    """``total_lists`` with one row per part."""

    def run(part: pa.Table) -> pa.Table:
        items, *counts = _merged(part)
        columns = _joined(items, [c.to_numpy() for c in counts], np.array([0, len(items)]))
        return pa.table([part.column("part").slice(0, 1), *columns], ["part", "items", "df", "n_texts"])

    return lists.groupBy("part").applyInArrow(run, TOTALS)


def total_rows(lists: DataFrame) -> DataFrame:
    """(value, df, n_texts) of ``total_lists``, one row per item."""

    def run(part: pa.Table) -> pa.Table:
        return pa.table(_merged(part), ["value", "df", "n_texts"])

    return lists.groupBy("part").applyInArrow(run, "value string, df bigint, n_texts bigint")


def word_lists(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """(kept columns, terms, length): the different words of each row's text, and its number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, ["__text"]):
            [(row, item)], words, n = _items([part.column("__text")], False)
            key = _different(row * n + item)
            ends = np.insert(np.cumsum(np.bincount(key // n, minlength=part.num_rows)), 0, 0).astype(np.int32)
            terms = pa.ListArray.from_arrays(pa.array(ends), words.take(pa.array(key % n)))
            length = pa.array(np.bincount(row, minlength=part.num_rows).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*part.select(keep).columns, terms, length], [*keep, "terms", "length"])

    fields = _fields(df.select(*keep))
    return df.select(*keep, spaced_words(F.col(text)).alias("__text")).mapInArrow(run, f"{fields}, terms array<string>, length int")


def with_overlap(df: DataFrame, query: str, doc: str) -> DataFrame:
    """Add token_overlap, the number of different words a row's two texts share, and query_length and
    document_length, their numbers of words."""
    added = ["token_overlap", "query_length", "document_length"]
    rows = df.drop(*added)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, ["__query", "__doc"]):
            [(q_row, q_item), (d_row, d_item)], _, n = _items([part.column("__query"), part.column("__doc")], False)
            both = np.sort(np.concatenate([_different(q_row * n + q_item), _different(d_row * n + d_item)]))
            both = both[1:][both[1:] == both[:-1]]
            counts = [pa.array(np.bincount(r, minlength=part.num_rows)) for r in (both // n, q_row, d_row)]
            yield pa.RecordBatch.from_arrays([*part.select(names).columns, *counts], [*names, *added])

    texts = rows.select("*", spaced_words(F.col(query)).alias("__query"), spaced_words(F.col(doc)).alias("__doc"))
    return texts.mapInArrow(run, ", ".join([_fields(rows), *[f"{c} bigint" for c in added]]))


def shared_rows(df: DataFrame, keep: list[str], query: str, doc: str, bigrams: bool, keyed: bool = False) -> DataFrame:
    """(kept columns, value, n, query_n, doc_len): the items that a row's two texts share, with the
    counts in document and query, and the number of items in the document. ``keyed`` as in ``count_rows``."""
    fields, value = _fields(df.select(*keep)), KEYS if keyed else VALUE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, ["__query", "__doc"]):
            [(q_row, q_item), (d_row, d_item)], words, n = _items([part.column("__query"), part.column("__doc")], bigrams)
            if not len(q_row) or not len(d_row):
                continue
            width = n * (n + 1)
            key, query_n = _counted(q_row * width + q_item)
            own = d_row * width + d_item
            at = np.minimum(np.searchsorted(key, own), len(key) - 1)
            count = np.bincount(at[key[at] == own], minlength=len(key))
            both = np.flatnonzero(count)
            row, item = key[both] // width, key[both] % width
            length = np.bincount(d_row, minlength=part.num_rows)[row]
            held = part.select(keep).take(pa.array(row))
            columns = [*held.columns, *_named(item, words, n, keyed), pa.array(count[both]), pa.array(query_n[both]), pa.array(length)]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *value, "n", "query_n", "doc_len"])

    texts = df.select(*keep, spaced_words(F.col(query)).alias("__query"), spaced_words(F.col(doc)).alias("__doc"))
    return texts.mapInArrow(run, f"{fields}, {_value_fields(keyed)}, n bigint, query_n bigint, doc_len bigint")
