"""Near-duplicates by SimHash fingerprints, found with the pigeonring principle.

A fingerprint's 64 bits are cut into a ring of segments. If two fingerprints differ in at
most ``limit`` bits, then at some segment a chain starts in which the first l segments
together differ in at most ``l * limit / segments`` bits, for every l. The first two
links of that chain are an equality join: one segment is equal, and the next differs in
at most one bit, so both agree once that bit is masked. The further links prune the
pairs that meet, and the full Hamming check decides.

Equal fingerprints are merged before the join. Of a small group that shares a key the
pairs that pass are put out, of a large one a spanning forest of links (each search step
compares the frontier with what is not reached yet, and removes what it reaches).
Components come from star contraction, rounds of joins and minima over written tables.

The bound is on bits alone: at a Jaccard similarity of 0.8 over five words texts differ in
5 to 14 bits, so such copies are linked only if nearer texts lie between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.shared import flat_bytes, small_batches, staged

SHINGLE_WORDS = 4
MAX_BITS = 4
SEGMENTS = 5
SEED = 42
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SHINGLES_AT_ONCE = 1 << 15


def shingle_bounds(text: bytes, words: int) -> tuple[bytes, list[int], list[int]]:
    """The text with A-Z lowered and single spaces between words, and where its shingles begin and end."""
    plain = b" ".join(text.translate(_LOWER).split())
    if not plain:
        return plain, [], []
    gaps = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
    starts, ends = np.r_[0, gaps + 1], np.r_[gaps, len(plain)]
    if len(starts) <= words:
        return plain, [0], [len(plain)]
    return plain, starts[: len(starts) - words + 1].tolist(), ends[words - 1 :].tolist()


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64 values; 0 without words."""
    plain, starts, ends = shingle_bounds(text, words)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), _SHINGLES_AT_ONCE):
        pairs = zip(starts[at : at + _SHINGLES_AT_ONCE], ends[at : at + _SHINGLES_AT_ONCE])
        hashes = b"".join([xxhash.xxh64_digest(plain[s:e], SEED) for s, e in pairs])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(counts * 2 > len(starts)).tobytes(), "big") if starts else 0


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = flat_bytes(batch.column("__text"))
            found = [_signed(fingerprint(data[at[i] : at[i + 1]].tobytes(), words)) for i in range(batch.num_rows)]
            names = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, pa.int64())], [*names, "fp"])

    return run


def with_fingerprint(docs: DataFrame, text: str = "text", words: int = SHINGLE_WORDS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``fp``, the fingerprint as a signed long. A null text has no words."""
    small_batches(docs.sparkSession)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(text), F.lit("")).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("__text").schema)
    return rows.mapInArrow(_fingerprints(words), f"{fields}, fp long")


def _ring(segments: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    edges = [round(i * 64 / segments) for i in range(segments + 1)]
    return [(low, high - low) for low, high in zip(edges, edges[1:])]


def _chain_masks(start: int, segments: int, limit: int) -> list[tuple[np.uint64, int]]:
    """What the first l segments from ``start`` on cover, and how many bits they may differ in."""
    ring, mask, out = _ring(segments), 0, []
    for length in range(1, segments + 1):
        low, width = ring[(start + length - 1) % segments]
        mask |= ((1 << width) - 1) << low
        out.append((np.uint64(mask), length * limit // segments))
    return out


def _keys(segments: int):
    ring = _ring(segments)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            fps = signed.view(np.uint64)
            for i, (low, width) in enumerate(ring):
                next_low, next_width = ring[(i + 1) % segments]
                own = (fps >> np.uint64(low)) & np.uint64((1 << width) - 1)
                other = (fps >> np.uint64(next_low)) & np.uint64((1 << next_width) - 1)
                for bit in range(next_width):
                    masked = other & np.uint64(~(1 << bit) & 0xFFFFFFFF)
                    key = (((np.uint64(i) << np.uint64(6)) | np.uint64(bit)) << np.uint64(width + next_width)) | (own << np.uint64(next_width)) | masked
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), i, np.int8)), pa.array(signed)], ["key", "start", "fp"])

    return run


def _pass(differ: np.ndarray, chain: list[tuple[np.uint64, int]]) -> np.ndarray:
    """Which differences keep within the chain's budgets; the last of them is the full Hamming check."""
    near = np.bitwise_count(differ) <= chain[-1][1]
    at = np.flatnonzero(near)
    for mask, most in chain[:-1]:
        at = at[np.bitwise_count(differ[at] & mask) <= most]
    near[:] = False
    near[at] = True
    return near


def _forest(fps: np.ndarray, chain: list[tuple[np.uint64, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the chain conditions connect, one for each fingerprint that is reached."""
    left, right = [], []
    rest = fps
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            one = frontier.pop()
            near = _pass(rest ^ one, chain)
            if near.any():
                got = rest[near]
                left.append(np.full(len(got), one, np.uint64))
                right.append(got)
                frontier.extend(got)
                rest = rest[~near]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _group_links(fps: np.ndarray, chain: list[tuple[np.uint64, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Links within a large group: all that pass if they are few, else a forest."""
    if len(fps) > 4_096:
        return _forest(fps, chain)
    left, right = [], []
    for begin in range(0, len(fps), 256):
        i, j = np.nonzero(np.bitwise_count(fps[begin : begin + 256, None] ^ fps[None, :]) <= chain[-1][1])
        i, j = i[j > i + begin] + begin, j[j > i + begin]
        ok = _pass(fps[i] ^ fps[j], chain)
        left.append(fps[i[ok]])
        right.append(fps[j[ok]])
        if sum(map(len, left)) > 8 * len(fps):
            return _forest(fps, chain)
    return np.concatenate(left), np.concatenate(right)


def _links(segments: int, limit: int, small: int = 48):
    chains = [_chain_masks(i, segments, limit) for i in range(segments)]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def near(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
        differ = a ^ b
        good = np.bitwise_count(differ) <= limit
        for i, chain in enumerate(chains):
            own = np.flatnonzero(good & (start == i))
            good[own] = _pass(differ[own], chain)
        return good

    def link(key: np.ndarray, start: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(key)])
        a, b = [], []
        # Small groups at once, by distance in the sorted order; large ones one by one.
        few = np.repeat(size <= small, size)
        for step in range(1, small):
            at = np.flatnonzero((key[step:] == key[:-step]) & few[step:])
            if not len(at):
                break
            ok = near(fp[at], fp[at + step], start[at])
            a.append(fp[at][ok])
            b.append(fp[at + step][ok])
        for k in np.flatnonzero(size > small):
            own = slice(first[k], first[k] + size[k])
            x, y = _group_links(fp[own], chains[start[first[k]]])
            a.append(x)
            b.append(y)
        if a:
            x, y = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "start", "fp")]
            new[2] = new[2].astype(np.int64).view(np.uint64)
            if not len(new[0]):
                continue
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            last = int(np.searchsorted(held[0], held[0][-1], "left"))
            if last:  # the last group may go on in the next batch
                yield from link(*(x[:last] for x in held))
                held = [x[last:] for x in held]
        if held is not None:
            yield from link(*held)

    return run


def fingerprint_links(fps: DataFrame, limit: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """(a, b): links that connect all of the distinct fingerprints ``fp`` that differ in at most ``limit`` bits."""
    if 2 * limit // segments != 1:
        raise ValueError("the second link of a chain is joined at one bit: take limit / segments from 0.5 to below 1")
    keys = fps.select("fp").mapInArrow(_keys(segments), "key long, start byte, fp long")
    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(_links(segments, limit), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): each node of the links (a, b) with the smallest node it can reach, roots left out.

    Star contraction: in turn every node hangs its larger, then its smaller neighbours on
    the smallest node it knows. The number of links does not grow, and the rounds are
    about the logarithm of a component's size.
    """

    def lowest(edges: DataFrame) -> DataFrame:
        return staged(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "star-minima")

    def state(edges: DataFrame):
        return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = staged(links.where("a != b").select("a", "b"), "links")
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.where("b > a").join(lowest(both), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = staged(large.distinct(), "large-star")
        small = large.join(lowest(large), "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        edges = staged(small.where("a != b").distinct(), "small-star")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def simhash_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = SHINGLE_WORDS, limit: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over
    links between fingerprints that differ in at most ``limit`` bits.

    Null and empty texts have fingerprint zero and are linked like any other; repeated
    rows share their component; a null doc_id is never a component's smallest unless all
    are null; an empty table gives an empty one.
    """
    prints = staged(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), words=words), "fingerprints")
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(fingerprint_links(nodes, limit))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = staged(rooted, "rooted")
    named = staged(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    of = staged(rooted.join(named, "root").select("fp", "component_id"), "fingerprint-components")
    return prints.join(of, "fp").select(F.col("doc_id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
