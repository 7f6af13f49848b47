"""Removal of long byte strings that occur more than once, within a document or across them.

The collection of texts is cut into shards that can be searched on their own. Every
window of ``width`` bytes has an anchor: the leftmost smallest of its 32-byte hashes.
Equal windows have equal anchors at equal places, so the windows of one anchor value are
a shard, and a segment (the text around one anchor whose windows it decides) is a
document of the shard. Equal segments are counted first, with partial aggregation; a
segment that occurs twice needs no search, and one of its copies stands for all.
Segments that are equal within one text (a line said over and over) are put together
where the text is read, so they are never rows of one key.

Within a shard the segments are lined up at their anchors and built up column by column
from the right. Each round puts one symbol in front of every segment's suffix and
updates the sorted order of the suffixes (the Burrows-Wheeler order of that column: a
stable sort of the new symbols in the old order) and the common prefix of each with its
predecessor. A window is repeated if the common prefix with a neighbour reaches
``width``. A round costs as much as there are segments, and there are at most
``2 * width`` rounds whatever the length of the documents; the external files are
Spark's sorted shuffle files, read group by group.

Shards with more than ``SHARD_SEGMENTS`` different segments (a passage that very many
documents quote) are not given to one task: their windows are counted by a 128-bit hash,
with partial aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.shared import flat_bytes, small_batches, staged, text_digest

WIDTH = 400
ANCHOR = 32
#: Different segments of one anchor that one task takes; larger shards are split by window.
SHARD_SEGMENTS = 1_000
#: Window starts worked on at a time within one text.
CHUNK = 1 << 21
_POSITION_BITS = 22
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _anchor_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 32 bytes from each place on, built by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(_MIX[0])
    h ^= h >> np.uint64(29)
    factor, length = np.uint64(_MIX[1]), 1
    while length < ANCHOR:
        h = h[:-length] * factor + h[length:]
        factor, length = factor * factor, length * 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(_MIX[2])
    return h ^ (h >> np.uint64(29))


def segments(data: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor value, first window, number of windows and anchor place of each segment of a text.

    Texts shorter than ``width`` have none. Very long texts are worked on in chunks of
    window starts; a segment cut at the border is two segments of the same shard."""
    found: list[tuple[np.ndarray, ...]] = []
    per_window = width - ANCHOR + 1
    low = np.uint64((1 << _POSITION_BITS) - 1)
    with np.errstate(over="ignore"):
        for begin in range(0, len(data) - width + 1, CHUNK):
            h = _anchor_hashes(data[begin : begin + CHUNK + width - 1])
            # The place in the low bits makes the leftmost of equal hashes the smallest.
            least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
            length = 1
            while length * 2 <= per_window:
                least = np.minimum(least[:-length], least[length:])
                length *= 2
            rest = per_window - length
            if rest:
                least = np.minimum(least[:-rest], least[rest:])
            place = (least & low).astype(np.int64)
            first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            count = np.diff(np.r_[first, len(place)])
            at = place[first]
            found.append((h[at].view(np.int64), first + begin, count, at + begin))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def equal_segments(
    shard: np.ndarray, content: np.ndarray, first: np.ndarray, count: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of one text that are equal: which segments are the first of their kind, which
    occur again in the text, and the runs (first window, number of windows) of the latter."""
    by = np.lexsort((content, shard))
    new = np.r_[True, (np.diff(shard[by]) != 0) | (np.diff(content[by]) != 0)]
    times = np.diff(np.r_[np.flatnonzero(new), len(by)])
    again = np.zeros(len(by), bool)
    again[by] = np.repeat(times > 1, times)
    at = np.flatnonzero(again)
    lead = np.flatnonzero(np.r_[True, first[at[1:]] != (first + count)[at[:-1]]][: len(at)])
    return np.sort(by[new]), again, first[at[lead]], np.add.reduceat(count[at], lead) if len(at) else count[at]


def _emit_segments(width: int):
    """A row for each different segment of a text, and one without a shard for each run of those that occur in it again."""
    schema = pa.schema(
        [("digest", pa.binary()), ("row_key", pa.int64()), ("shard", pa.int64()), ("content", pa.int64()), ("first", pa.int64()), ("windows", pa.int32()), ("anchor", pa.int64()), ("again", pa.bool_())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = flat_bytes(batch.column("text"))
            digests, keys = batch.column("digest").to_pylist(), batch.column("row_key").to_pylist()
            out: list[list] = [[] for _ in schema]
            for i in range(batch.num_rows):
                own = data[at[i] : at[i + 1]]
                if len(own) < width:
                    continue
                shard, first, count, anchor = segments(own, width)
                view = memoryview(own)
                contents = [
                    _signed(xxhash.xxh3_64_intdigest(view[f : f + n + width - 1]))
                    for f, n in zip(first.tolist(), count.tolist())
                ]
                n, again = len(shard), [False] * len(shard)
                if len(set(contents)) < n:
                    one, again, run_first, run_windows = equal_segments(shard, np.array(contents, np.int64), first, count)
                    m = len(run_first)
                    for k, values in enumerate(([digests[i]] * m, [keys[i]] * m, [None] * m, [None] * m, run_first, run_windows, [None] * m, [True] * m)):
                        out[k].extend(values)
                    n, again, contents = len(one), again[one], [contents[j] for j in one.tolist()]
                    shard, first, count, anchor = shard[one], first[one], count[one], anchor[one]
                for k, values in enumerate(([digests[i]] * n, [keys[i]] * n, shard, contents, first, count, anchor, again)):
                    out[k].extend(values)
                if len(out[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema)], schema=schema)
                    out = [[] for _ in schema]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema)], schema=schema)

    return run, "digest binary, row_key long, shard long, content long, first long, windows int, anchor long, again boolean"


def repeated_windows(
    shard: np.ndarray, begin: np.ndarray, end: np.ndarray, data: np.ndarray, offsets: np.ndarray, width: int = WIDTH
) -> list[tuple[int, int, int]]:
    """Runs of repeated windows of the segments of some whole shards.

    ``begin``/``end``: the segment's first column and the column after its last,
    relative to its anchor; its bytes are ``data[offsets[i]:]``. Segments of one shard
    are next to each other and different. Returns (segment, first column, number).
    """
    n = len(shard)
    group = np.cumsum(np.r_[True, shard[1:] != shard[:-1]]).astype(np.int64) if n else np.zeros(0, np.int64)
    columns = [[] for _ in range(2)]
    order = np.zeros(0, np.int64)  # segments by shard, then by their suffix from this column on
    common = np.zeros(0, np.int64)  # common prefix with the one before
    enters = np.argsort(-end, kind="stable")
    entered, lowest = 0, int(begin.min()) if n else 0
    for column in range(int(end.max()) - 1 if n else -1, lowest - 1, -1):
        stop = entered
        while stop < n and end[enters[stop]] > column:
            stop += 1
        if stop > entered:
            # Their suffixes are empty so far: they sort before the others of their shard.
            new = enters[entered:stop]
            order = np.concatenate([new, order])
            common = np.concatenate([np.zeros(len(new), np.int64), common])
            by_group = np.argsort(group[order], kind="stable")
            order, common = order[by_group], common[by_group]
            entered = stop
        live = begin[order] <= column
        if not live.all():
            # One that has ended goes; its successor's prefix with what is left is the smaller of both.
            kept = np.flatnonzero(live)
            if not len(kept):
                order, common = order[:0], common[:0]
                continue
            least = np.minimum.reduceat(common[: kept[-1] + 1], np.r_[0, kept[:-1] + 1])
            order, common = order[kept], least
        symbol = data[offsets[order] + (column - begin[order])].astype(np.int64)
        key = group[order] * 256 + symbol
        turn = np.argsort(key, kind="stable")
        order, key = order[turn], key[turn]
        # Common prefix with the new predecessor: one more than the least on the way between
        # them in the old order, if both got the same symbol in the same shard.
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        after = np.zeros(len(order), np.int64)
        if len(same):
            low, high = turn[same - 1] + 1, turn[same] + 1
            padded = np.append(common, 0)
            after[same] = 1 + np.minimum.reduceat(padded, np.stack([low, high], 1).ravel())[::2]
        common = after
        long = common >= width
        if long.any():
            hit = long.copy()
            hit[:-1] |= long[1:]
            columns[0].append(order[hit])
            columns[1].append(np.full(int(hit.sum()), column))
    if not columns[0]:
        return []
    who, where = np.concatenate(columns[0]), np.concatenate(columns[1])
    by = np.lexsort((where, who))
    who, where = who[by], where[by]
    first = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (where[1:] != where[:-1] + 1)])
    return list(zip(who[first].tolist(), where[first].tolist(), np.diff(np.r_[first, len(who)]).tolist()))


def _search_shards(width: int, batch_bytes: int = 1 << 22):
    """Rows sorted by shard -> repeated runs of window starts, as places in the text."""
    schema = pa.schema([("digest", pa.binary()), ("first", pa.int64()), ("windows", pa.int32())])

    def search(rows: list[tuple]) -> pa.RecordBatch:
        seen, kept = set(), []
        for row in rows:  # a copy of a document brings its segments again
            if (key := (row[0], row[1])) not in seen:
                seen.add(key)
                kept.append(row)
        data = np.frombuffer(b"".join(r[6] for r in kept), np.uint8)
        lengths = np.array([len(r[6]) for r in kept], np.int64)
        offsets = np.r_[0, np.cumsum(lengths)[:-1]]
        first, anchor = np.array([r[4] for r in kept], np.int64), np.array([r[5] for r in kept], np.int64)
        begin = first - anchor
        runs = repeated_windows(np.array([r[0] for r in kept], np.int64), begin, begin + lengths, data, offsets, width)
        runs = [(kept[i][3], kept[i][5] + c, n) for i, c, n in runs if kept[i][2]]
        columns = list(zip(*runs)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "content", "single", "digest", "first", "anchor", "piece"))):
                if rows and size >= batch_bytes and rows[-1][0] != row[0]:
                    yield search(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[6])
        if rows:
            yield search(rows)

    return run, "digest binary, first long, windows int"


def _cut_pieces(width: int, by_window: bool):
    """Take the listed segments out of their texts; ``by_window``: a hash of each window instead."""
    plain = [("shard", pa.int64()), ("content", pa.int64()), ("single", pa.bool_()), ("digest", pa.binary()), ("first", pa.int64()), ("anchor", pa.int64()), ("piece", pa.binary())]
    hashed = [("window", pa.binary()), ("content", pa.int64()), ("single", pa.bool_()), ("digest", pa.binary()), ("first", pa.int64())]
    schema = pa.schema(hashed if by_window else plain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = flat_bytes(batch.column("text"))
            wanted, digests = batch.column("wanted").to_pylist(), batch.column("digest").to_pylist()
            out: list[tuple] = []
            for i in range(batch.num_rows):
                own = memoryview(data[at[i] : at[i + 1]])
                for w in wanted[i]:
                    f, n = w["first"], w["windows"]
                    if by_window:
                        out += [
                            (xxhash.xxh3_128_digest(own[s : s + width]), w["content"], w["single"], digests[i], s)
                            for s in range(f, f + n)
                        ]
                    else:
                        piece = own[f : f + n + width - 1].tobytes()
                        out.append((w["shard"], w["content"], w["single"], digests[i], f, w["anchor"], piece))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), schema)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), schema)], schema=schema)

    names = {pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean"}
    return run, ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def repeated_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """(digest, spans): for each different text with repeats, the runs (first window start,
    number of window starts) of windows of ``width`` bytes that start anywhere else too.

    ``digest`` is ``text_digest`` of the text. Null texts count as empty; equal texts and
    repeated rows are copies of each other; other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(
        text_digest(F.col(text)).alias("digest"),
        F.xxhash64(F.col(doc_id)).alias("row_key"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).where(F.octet_length("text") >= width)
    run, schema = _emit_segments(width)
    emitted = staged(rows.mapInArrow(run, schema), "segments")
    within, found = emitted.where("shard is null"), emitted.where("shard is not null")
    # Written, so that the join meets two plain exchanges: adaptive execution splits a hot shard.
    shared_anchor = staged(found.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1").select("shard"), "shared-anchors")
    found = staged(found.join(shared_anchor, "shard"), "shared-segments")

    classes = found.groupBy("shard", "content").agg(
        ((F.count("*") == 1) & ~F.max("again")).alias("single"), F.min(F.struct("row_key", "digest", "first", "windows", "anchor")).alias("one")
    )
    classes = staged(classes.select("shard", "content", "single", "one.*"), "segment-classes")
    copies = found.where("not again").join(classes.where("not single").select("shard", "content"), ["shard", "content"])

    shards = classes.groupBy("shard").agg(
        F.count("*").alias("size"), F.max("single").alias("open")
    ).where("size > 1 and open").select("shard", "size")
    asked = classes.join(staged(shards, "shard-sizes"), "shard")  # two plain exchanges again

    def pieces_of(some: DataFrame, by_window: bool) -> DataFrame:
        wanted = some.groupBy("digest", "row_key").agg(
            F.collect_list(F.struct("shard", "content", "single", "first", "windows", "anchor")).alias("wanted")
        )
        run, schema = _cut_pieces(width, by_window)
        return rows.join(wanted, ["digest", "row_key"]).select("digest", "text", "wanted").mapInArrow(run, schema)

    run, schema = _search_shards(width)
    small = pieces_of(asked.where(F.col("size") <= SHARD_SEGMENTS), False)
    searched = small.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, schema)

    windows = staged(pieces_of(asked.where(F.col("size") > SHARD_SEGMENTS), True).distinct(), "hot-windows")
    twice = staged(windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window"), "repeated-windows")
    split = windows.where("single").join(twice, "window").select("digest", "first", F.lit(1).alias("windows"))

    spans = within.select("digest", "first", "windows").unionByName(copies.select("digest", "first", "windows"))
    spans = spans.unionByName(searched).unionByName(split)
    return spans.groupBy("digest").agg(F.collect_set(F.struct("first", "windows")).alias("spans"))


def _cut(width: int, with_text: bool):
    schema = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    names = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = flat_bytes(batch.column("__text"))
            out, kept_texts = [], []
            for i, spans in enumerate(batch.column("__spans").to_pylist()):
                own = data[at[i] : at[i + 1]].tobytes()
                kept, upto, removed, n_spans = [], 0, 0, 0
                for first, count in sorted((s["first"], s["windows"]) for s in spans or ()):
                    end = first + count + width - 1
                    if first > upto or not n_spans:
                        kept.append(own[upto:first])
                        n_spans += 1
                        removed += end - first
                    else:
                        removed += max(0, end - upto)
                    upto = max(upto, end)
                kept.append(own[upto:])
                left = b"".join(kept)
                out.append((len(own), removed, n_spans, hashlib.sha256(left).hexdigest()))
                kept_texts.append(left.decode("utf-8", "ignore") if with_text else None)
            columns = [pa.array(v, f[1]) for v, f in zip(list(zip(*out)) or [()] * 4, schema)]
            own_columns = [c for c in batch.schema.names if not c.startswith("__")]
            arrays = [batch.column(c) for c in own_columns] + columns
            fields = own_columns + [f[0] for f in schema]
            if with_text:
                arrays.append(pa.array(kept_texts, pa.string()))
                fields.append("kept_text")
            yield pa.RecordBatch.from_arrays(arrays, fields)

    return run, names + (", kept_text string" if with_text else "")


def remove_repeats(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, with_text: bool = False
) -> DataFrame:
    """One row per document: its id, n_bytes, n_removed, n_spans (maximal removed runs) and
    the sha256 of the bytes that remain; ``with_text`` adds them as ``kept_text`` (characters
    that a cut has split are left out of it).

    A byte goes if a string of ``width`` bytes over it starts anywhere else too, in the
    same text or another. Null texts count as empty; texts shorter than ``width`` stay
    whole; every row counts as a document, so equal texts remove each other entirely;
    an empty table gives an empty one.
    """
    spans = repeated_spans(docs, text, doc_id, width)
    rows = docs.select(
        F.col(doc_id).alias(doc_id), F.coalesce(F.col(text), F.lit("")).alias("__text"), text_digest(F.col(text)).alias("__digest")
    )
    joined = rows.join(spans.select(F.col("digest").alias("__digest"), F.col("spans").alias("__spans")), "__digest", "left")
    run, names = _cut(width, with_text)
    kind = docs.schema[doc_id].dataType.simpleString()
    return joined.select(doc_id, "__text", "__spans").mapInArrow(run, f"`{doc_id}` {kind}, {names}")
