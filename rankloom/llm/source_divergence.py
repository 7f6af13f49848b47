"""Source divergence audit by chunk factorization.

Texts are counted as whitespace chunks, not as terms. A task counts the chunks of its
documents per language and source, and names the documents that hold a chunk, as many as
``min_documents``: more are never asked for. Rows of equal chunks meet, each chunk that
occurs anywhere is cut into terms once, and its terms take over its counts and documents.
Rows of equal terms meet next; with ``min_documents`` different documents a term is kept.
Counts of several sources travel in one row, written one after the other as bytes.

What follows works on the counts of terms per source. Sources are compared in tiles: a
group holds some of the terms and two ranges of the sources, so no group grows with the
number of terms or sources.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.llm.shared import PIECE_BYTES, flat_bytes, small_batches, staged

MIN_DOCUMENTS = 10
TOP_TERMS = 10

#: Counts and document ids that a task holds before it puts them out, and terms likewise.
HELD_COUNTS = 600_000
HELD_TERMS = 100_000
#: Bytes of counts from which on those of the same source are added up.
LONG_COUNTS = 1 << 16
#: Terms and sources of a tile, on average and at most.
TILE_TERMS = 4_096
TILE_SOURCES = 64

_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_ID = 8

_CHUNKS = "lang string, chunk binary, docs binary, counts binary"
_TERMS = "lang string, term binary, docs binary, counts binary"
_KEPT = "lang string, source string, term binary, n long, n_lang long"


def text_pieces(text: bytes, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """The text in parts of about ``size`` bytes, cut at white space only."""
    first = 0
    while len(text) - first > size:
        cut = _SPACE.search(text, first + size)
        if cut is None:
            break
        yield text[first : cut.start()]
        first = cut.end()
    yield text[first:] if first else text


def chunk_terms(chunk: bytes) -> dict[bytes, int]:
    """The terms of a chunk and how often each occurs in it; only A-Z are lower-cased."""
    return Counter(_TERM.findall(chunk.lower()))


def _number(n: int) -> bytes:
    """A whole number in as few bytes as it needs, seven bits each."""
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


_SMALL = [_number(n) for n in range(1 << 12)]


def write_count(source: bytes, n: int) -> bytes:
    """One source's count; several are written one after the other, also twice for a source."""
    return _number(len(source)) + source + (_SMALL[n] if n < len(_SMALL) else _number(n))


def read_counts(counts: bytes) -> dict[bytes, int]:
    """Counts by source."""
    found: dict[bytes, int] = {}
    i, end = 0, len(counts)
    while i < end:
        length, i = counts[i], i + 1
        if length > 127:
            length, i = _read_number(counts, i - 1)
        source = counts[i : i + length]
        i += length
        n, i = counts[i], i + 1
        if n > 127:
            n, i = _read_number(counts, i - 1)
        found[source] = found.get(source, 0) + n
    return found


def _read_number(data: bytes, i: int) -> tuple[int, int]:
    n = data[i]
    if n < 128:
        return n, i + 1
    n, shift = n & 127, 7
    while data[i := i + 1] > 127:
        n |= (data[i] & 127) << shift
        shift += 7
    return n | data[i] << shift, i + 1


def _times(counts: bytes, k: int) -> bytes:
    return counts if k == 1 else b"".join(write_count(s, n * k) for s, n in read_counts(counts).items())


class _Sum:
    """Documents and counts of rows added up; documents are None where there are ``least`` or more."""

    __slots__ = ("docs", "counts", "longest")

    def __init__(self, docs: bytes | None, counts: bytes):
        self.docs, self.counts, self.longest = docs, counts, LONG_COUNTS

    def add(self, docs: bytes | None, counts: bytes, least: int) -> None:
        if self.docs is None or docs is None:
            self.docs = None
        else:
            both = self.docs + docs
            ids = {both[i : i + _ID] for i in range(0, len(both), _ID)}
            self.docs = b"".join(ids) if len(ids) < least else None
        self.counts += counts
        if len(self.counts) > self.longest:
            self.counts = b"".join(write_count(s, n) for s, n in read_counts(self.counts).items())
            self.longest = LONG_COUNTS + 2 * len(self.counts)


def _batch(names: str, *columns: list) -> pa.RecordBatch:
    kinds = {"lang": pa.string(), "source": pa.string(), "n": pa.int64(), "n_lang": pa.int64()}
    fields = names.split()
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.binary())) for n, c in zip(fields, columns)], fields)


class _Chunks:
    """What a task knows of its documents' chunks: counts by language and source, and by
    language the documents of a chunk until there are ``least``."""

    def __init__(self, task: int, least: int):
        self.next_id, self.least, self.held = task << 32, least, 0
        self.counts: dict[tuple, Counter] = {}
        self.docs: dict[str, dict] = {}
        self.full: dict[str, set] = {}

    def add(self, lang: str, source: str, text: bytes) -> None:
        counts = self.counts.setdefault((lang, source), Counter())
        docs, full = self.docs.setdefault(lang, {}), self.full.setdefault(lang, set())
        own, last = self.next_id.to_bytes(_ID, "big"), (self.least - 1) * _ID
        self.next_id += 1
        self.held -= len(counts)
        for i, piece in enumerate(text_pieces(text)):
            chunks = piece.split()
            counts.update(chunks)
            new = set(chunks).difference(full)
            if i:  # some are known from the pieces before
                new = [chunk for chunk in new if not docs.get(chunk, b"").endswith(own)]
            for chunk in new:
                known = docs.get(chunk, b"")
                if len(known) == last:
                    full.add(chunk)
                    docs.pop(chunk, None)
                    self.held -= last // _ID
                else:
                    docs[chunk] = known + own
                    self.held += 1
        self.held += len(counts)

    def flush(self, everything: bool) -> Iterator[pa.RecordBatch]:
        """Put out the chunks with few documents, or all. Chunks that are known to have enough
        documents come again and again, so their counts are best kept for a while."""
        for lang, docs in self.docs.items():
            full, written = self.full[lang], {}
            for (other, source), counts in self.counts.items():
                if other != lang:
                    continue
                name = source.encode()
                name = _number(len(name)) + name
                stay = Counter()
                for chunk, n in counts.items():
                    if not everything and chunk in full:
                        stay[chunk] = n
                    else:
                        written[chunk] = written.get(chunk, b"") + name + (_SMALL[n] if n < len(_SMALL) else _number(n))
                self.counts[other, source] = stay
            yield _batch("lang chunk docs counts", [lang] * len(written), list(written), [docs.get(c) for c in written], list(written.values()))
            docs.clear()
        self.held = sum(map(len, self.counts.values()))
        if everything:
            self.counts.clear()
            if sum(map(len, self.full.values())) >= HELD_COUNTS:
                self.full = {lang: set() for lang in self.full}


def _count_chunks(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _Chunks(TaskContext.get().partitionId(), least)
        for batch in batches:
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            texts = batch.column("text")
            for i in range(batch.num_rows):
                chunks.add(langs[i], sources[i], texts[i].as_py())
                if chunks.held >= HELD_COUNTS:
                    yield from chunks.flush(False)
                    if chunks.held >= HELD_COUNTS // 2:
                        yield from chunks.flush(True)
        yield from chunks.flush(True)

    return run


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], least: int) -> Iterator[tuple]:
    """(*key, documents, counts) of each run of rows with equal keys, added up.

    The bytes of a run's rows lie one after the other in a batch, so only a run that goes
    on from one batch to the next is added up by hand. Documents are None where a row says
    that there are enough, else the ids of all rows.
    """
    last, held = None, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        same = np.ones(n - 1, bool)
        for key in keys:
            column = batch.column(key)
            same &= pc.equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False).astype(bool)
        starts = np.flatnonzero(np.r_[True, ~same])
        enough = np.logical_or.reduceat(batch.column("docs").is_null().to_numpy(zero_copy_only=False), starts)
        docs, docs_at = flat_bytes(batch.column("docs"))
        counts, counts_at = flat_bytes(batch.column("counts"))
        docs, counts, bounds = docs.tobytes(), counts.tobytes(), np.r_[starts, n]
        named = [batch.column(key).take(pa.array(starts)).to_pylist() for key in keys]
        at, more = docs_at[bounds].tolist(), counts_at[bounds].tolist()
        for i, (key, none) in enumerate(zip(zip(*named), enough.tolist())):
            own = None if none else docs[at[i] : at[i + 1]]
            its = counts[more[i] : more[i + 1]]
            if key == last:
                held.add(own, its, least)
                continue
            if last is not None:
                yield *last, held.docs, held.counts
            last, held = key, _Sum(own, its)
    if last is not None:
        yield *last, held.docs, held.counts


def _cut_chunks(least: int):
    """Rows of terms out of rows sorted by chunk, added up as far as a task can hold them."""

    def out(held: dict[tuple, _Sum]) -> pa.RecordBatch:
        langs, terms = zip(*held) if held else ((), ())
        return _batch("lang term docs counts", langs, terms, [x.docs for x in held.values()], [x.counts for x in held.values()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, _Sum] = {}
        chunk, terms = None, {}
        for now, lang, docs, counts in _runs(batches, ["chunk", "lang"], least):
            if now != chunk:
                chunk, terms = now, chunk_terms(now)
            # A document is in one row of a chunk only.
            if docs is not None and len(docs) >= least * _ID:
                docs = None
            for term, k in terms.items():
                known = held.get((lang, term))
                if known is None:
                    held[lang, term] = _Sum(docs, _times(counts, k))
                else:
                    known.add(docs, _times(counts, k), least)
            if len(held) >= HELD_TERMS:
                yield out(held)
                held.clear()
        yield out(held)

    return run


def _keep_terms(least: int):
    """Counts by source of the terms with enough documents, out of rows sorted by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: tuple[list, ...] = ([], [], [], [], [])
        for lang, term, docs, counts in _runs(batches, ["lang", "term"], least):
            # Rows of a term may name a document twice.
            if docs is not None and (len(docs) < least * _ID or len({docs[i : i + _ID] for i in range(0, len(docs), _ID)}) < least):
                continue
            by_source = read_counts(counts)
            m = len(by_source)
            own = ([lang] * m, [s.decode() for s in by_source], [term] * m, by_source.values(), [sum(by_source.values())] * m)
            for column, values in zip(columns, own):
                column += values
            if len(columns[0]) >= HELD_TERMS:
                yield _batch("lang source term n n_lang", *columns)
                columns = ([], [], [], [], [])
        yield _batch("lang source term n n_lang", *columns)

    return run


def kept_terms(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_documents: int = MIN_DOCUMENTS
) -> DataFrame:
    """(lang, source, term binary, n, n_lang): how often the source and its language have each term
    that at least ``min_documents`` rows of the language hold; sources without it have no row.

    Nulls count as ''; each row is a document.
    """
    if min_documents < 1:
        raise ValueError("min_documents is 1 at least")
    small_batches(docs.sparkSession)
    own = docs.select(*_group(docs, lang, source), _known(docs, text).cast("binary").alias("text"))
    # A key has a row per task that met it (or per filling of its memory), however often it
    # occurs, and is added up as a stream: no group is held.
    chunks = own.mapInArrow(_count_chunks(min_documents), _CHUNKS)
    terms = chunks.repartition("chunk").sortWithinPartitions("chunk", "lang").mapInArrow(_cut_chunks(min_documents), _TERMS)
    return terms.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_keep_terms(min_documents), _KEPT)


def _known(docs: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def _group(docs: DataFrame, lang: str, source: str) -> list[Column]:
    return [_known(docs, lang).alias("lang"), _known(docs, source).alias("source")]


def _billionths(count: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 * (count + 2) / (total + 2 * terms)) in longs, three digits at a time:
    exact while the divisor is below 9.2 * 10^15."""
    d = f"({total} + 2 * {terms})"
    x1 = f"(({count} + 2) * 1000)"
    x2 = f"({x1} % {d} * 1000)"
    x3 = f"({x2} % {d} * 1000)"
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1 + 1000000 * ({x1} div {d}) + 1000 * ({x2} div {d}) + {x3} div {d} ELSE 0L END")


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)), 0 for two zeros."""
    return (p - q) ** 2 // np.maximum(p + q, 1)


def _compare_tile(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """What the terms of one tile add to the value of each pair of its sources.

    Rows without a term give a source's share of a term it does not hold. Terms that are
    in no source of the tile are counted with the first tile of terms, all at once.
    """
    lang, low, high, bucket = key
    absent = rows["term"].isna()
    base = rows[absent].sort_values("at")
    cells = rows[~absent]
    at, names, p0 = base["at"].to_numpy(), base["source"].to_numpy(), base["p"].to_numpy(np.int64)
    term, known = pd.factorize(cells["term"])
    shares = np.repeat(p0[:, None], len(known), 1)
    shares[np.searchsorted(at, cells["at"].to_numpy()), term] = cells["p"].to_numpy(np.int64)
    terms = int(base["terms"].iloc[0]) if bucket == 0 else 0
    first, second, values = [], [], []
    for i in np.flatnonzero(at // TILE_SOURCES == low):
        others = np.flatnonzero((at // TILE_SOURCES == high) & (at > at[i]))
        both_absent = _gap(p0[others], p0[i])
        values.append(_gap(shares[others], shares[i]).sum(1) + (terms - len(known)) * both_absent)
        first += [names[i]] * len(others)
        second += list(names[others])
    value = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pd.DataFrame({"lang": lang, "first": first, "second": second, "value": value.astype(np.int64)})


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of a language's sources."""
    tiles = "explode(sequence(0, cast((sources - 1) div {0} as int)))".format(TILE_SOURCES)
    buckets = "cast((terms + {0}) div {1} as int)".format(TILE_TERMS - 1, TILE_TERMS)
    columns = ["lang", "at", "sources", "terms", "bucket", "source", "term", "p"]
    cells = (
        kept.withColumn("p", _billionths("n", "total", "terms"))
        .withColumn("bucket", F.expr(f"int(pmod(xxhash64(term), {buckets}))"))
        .select(*columns)
    )
    absent = (
        groups.withColumn("p", _billionths("0L", "total", "terms"))
        .withColumn("bucket", F.expr(f"explode(sequence(0, greatest({buckets}, 1) - 1))"))
        .withColumn("term", F.lit(None).cast("binary"))
        .select(*columns)
    )
    placed = (
        cells.withColumn("source", F.lit(None).cast("string"))
        .unionByName(absent)
        .where("sources > 1")
        .withColumn("own", F.expr(f"cast(at div {TILE_SOURCES} as int)"))
        .withColumn("other", F.expr(tiles))
        .select(
            "lang", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
            "bucket", "at", "source", "terms", "term", "p",
        )
    )
    partial = placed.groupBy("lang", "low", "high", "bucket").applyInPandas(
        _compare_tile, "lang string, first string, second string, value long"
    )
    summed = partial.groupBy("lang", "first", "second").agg(F.sum("value").alias("value"))
    both = F.explode(
        F.array(
            F.struct(F.col("first").alias("source"), F.col("second").alias("item")),
            F.struct(F.col("second").alias("source"), F.col("first").alias("item")),
        )
    )
    return summed.select("lang", both.alias("pair"), "value").select("lang", "pair.source", "pair.item", "value")


def audit_sources(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    min_documents: int = MIN_DOCUMENTS,
    top: int = TOP_TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the sources of a language are apart.

    A language keeps the terms that at least ``min_documents`` of its rows hold. Part
    ``pair`` has a row for every other source of the language, part ``term`` the ``top``
    terms that a source holds more of than its language does. Shares are whole billionths
    with two added to each count, so all values are exact; ranks go by value from the
    highest, then by the item's bytes.

    Null texts, languages and sources count as ''; each row is a document, repeated ones
    too. A group without kept terms has its pairs and no terms, the pairs of a language
    without kept terms have value 0, an empty table gives no rows, and a language with one
    source no pairs. Texts of any length are read whole, in parts cut at white space. Only
    the three named columns are read, so others may have any name.
    """
    kept = staged(kept_terms(docs, text, lang, source, min_documents), "kept-terms")
    terms = kept.groupBy("lang", "term").agg(F.max("n_lang").alias("n_lang"))
    by_lang = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n_lang").alias("lang_total"))
    by_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    place = W.partitionBy("lang")
    groups = (
        docs.select(*_group(docs, lang, source))
        .distinct()
        .join(by_lang, "lang", "left")
        .join(by_source, ["lang", "source"], "left")
        .na.fill(0, ["terms", "lang_total", "total"])
        .withColumn("at", F.row_number().over(place.orderBy("source")) - 1)
        .withColumn("sources", F.count("*").over(place))
    )
    groups = staged(groups, "source-groups")
    kept = kept.join(groups, ["lang", "source"])
    over = (
        kept.withColumn("p", _billionths("n", "total", "terms"))
        .withColumn("q", _billionths("n_lang", "lang_total", "terms"))
        .where("p > q")
        .select("lang", "source", F.col("term").cast("string").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    )
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    parts = [
        _pairs(kept, groups).withColumn("rank", rank).withColumn("part", F.lit("pair")),
        over.withColumn("rank", rank).where(F.col("rank") <= top).withColumn("part", F.lit("term")),
    ]
    return parts[0].unionByName(parts[1]).select("lang", "source", "part", "item", "value", "rank")
