"""Vector codes by product quantization, with distances in whole numbers only.

Components become integers, vectors are cut into equal parts, and each part is coded by
the nearest entry of its codebook. Parts and entries are filled with zeros to a power of
two and go through the integer Walsh-Hadamard transform, which multiplies every squared
distance by that power. Its coefficients come in sequency order, so the slow changes, which
mostly hold most of the distance, are added first; an entry is left out as soon as what
it has reached exceeds the whole distance of another entry.

A round is one job: tasks put out sums and counts per entry, which Spark adds up. Only
codebooks, whose size is fixed by the number of entries, go to the tasks and back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.shared import staged
from rankloom.operators.skew import largest, salted_lookup

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4

#: Numbers of a (vectors x entries) table that a task works on at a time.
TILE_CELLS = 1 << 16
#: The part of the coefficients that is added for all entries, and how many are added between
#: two looks at which entries are left.
FIRST_SHARE = 0.75
COEFFICIENTS_AT_ONCE = 4
_LONGEST = (1 << 63) - 1
_LIMB = 10**25


def sequency_order(size: int) -> np.ndarray:
    """Rows of the natural Hadamard matrix of ``size`` (a power of two) by number of sign changes."""
    bits = size.bit_length() - 1
    gray = np.arange(size) ^ (np.arange(size) >> 1)
    return sum(((gray >> b & 1) << (bits - 1 - b) for b in range(bits)), np.zeros(size, np.int64))


def walsh(values: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the last axis, filled with zeros to a power of two; in sequency order."""
    width = values.shape[-1]
    size = 1 << max(0, width - 1).bit_length()
    out = np.zeros((*values.shape[:-1], size), values.dtype)
    out[..., :width] = values
    half = 1
    while half < size:
        pairs = out.reshape(*values.shape[:-1], size // (2 * half), 2, half)
        a, b = pairs[..., 0, :], pairs[..., 1, :]
        out = np.stack([a + b, a - b], axis=-2).reshape(*values.shape[:-1], size)
        half *= 2
    return out[..., sequency_order(size)]


def whole_type(largest_component: int, width: int):
    """int64 where sums of ``4 * width`` scaled squares cannot leave it, else Python's integers."""
    size = 1 << max(0, width - 1).bit_length()
    return np.int64 if size * size * size * (2 * largest_component) ** 2 < 1 << 62 else object


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the nearest entry of each part, ties to the lower entry.

    ``parts`` (n x width) and ``entries`` (k x width) are integers.
    """
    largest_component = max(int(abs(parts).max(initial=0)), int(abs(entries).max(initial=0)))
    kind = whole_type(largest_component, parts.shape[1])
    rows, book = walsh(parts.astype(kind)), walsh(entries.astype(kind))
    size, step = rows.shape[1], max(1, TILE_CELLS // len(entries))
    found, distance = np.zeros(len(rows), np.int64), np.zeros(len(rows), kind)
    for first in range(0, len(rows), step):
        some = slice(first, first + step)
        found[some], distance[some] = _nearest_of_tile(rows[some], book)
    return found, distance // size


def _nearest_of_tile(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries and scaled distances: the first coefficients for all entries, then only for those left."""
    size, kind = rows.shape[1], rows.dtype
    done = max(1, int(size * FIRST_SHARE))
    by_row, by_entry = np.ascontiguousarray(rows.T), np.ascontiguousarray(book.T)
    reached = np.zeros((len(rows), len(book)), kind)
    for c in range(done):
        gap = by_row[c][:, None] - by_entry[c]
        gap *= gap
        reached += gap
    # The whole distance of the entry that leads so far is a bound: what exceeds it is out.
    leads = reached.argmin(1)
    bound = ((rows - book[leads]) ** 2).sum(1)
    row, entry = np.nonzero(reached <= bound[:, None])
    reached, bound = reached[row, entry], bound[row]
    while done < size:
        upto = min(size, done + COEFFICIENTS_AT_ONCE)
        for c in range(done, upto):
            gap = by_row[c].take(row) - by_entry[c].take(entry)
            reached += gap * gap
        left = reached <= bound
        row, entry, reached, bound, done = row[left], entry[left], reached[left], bound[left], upto
    # The first of a row's entries with the least distance; rows and entries are in order.
    starts = np.searchsorted(row, np.arange(len(rows)))
    least = np.minimum.reduceat(reached, starts)
    best = np.flatnonzero(reached == least[row])
    best = best[np.searchsorted(row[best], np.arange(len(rows)))]
    return entry[best], least


def usable(vector: Column) -> Column:
    """Whether a vector and all of its components are there and finite."""
    finite = F.forall(vector, lambda x: F.coalesce((F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return F.coalesce(finite, F.lit(False))


def _whole(vectors: pa.Array, width: int, scale: int) -> np.ndarray:
    """floor(scale * component) as a matrix, zeros where a vector is shorter."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(scale * vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64))
    if len(flat) and np.abs(flat).max() < 1 << 52:
        flat, kind = flat.astype(np.int64), np.int64
    else:
        flat, kind = np.array([int(x) for x in flat], object), object
    out = np.zeros((len(lengths), width), kind)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def _parts(matrix: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    return ((p, part) for p, part in enumerate(np.split(matrix, parts, axis=1)))


def _limbs(total: int) -> list[int]:
    """A sum of any size in pieces that fit a decimal, the lowest first."""
    pieces = []
    while abs(total) >= _LIMB:
        total, rest = divmod(total, _LIMB)
        pieces.append(rest)
    return [*pieces, total]


def _add_up(shared, width: int, scale: int):
    """Sums and counts of what is nearest to each entry: a row per part, entry and position (more
    where a sum has over 25 digits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        parts, entries, length = books.shape
        counts = np.zeros((parts, entries), np.int64)
        sums = np.zeros((parts, entries, length), object)
        for batch in batches:
            for p, part in _parts(_whole(batch.column(0), width, scale), parts):
                code = nearest(part, books[p])[0]
                counts[p] += np.bincount(code, minlength=entries)
                if part.dtype == object:
                    np.add.at(sums[p], code, part)
                    continue
                own = np.zeros((entries, length), np.int64)
                np.add.at(own, code, part)
                sums[p] += own
        p, e = np.nonzero(counts)
        if len(p):
            whole = [(i, limb, v) for i, total in enumerate(sums[p, e].ravel()) for limb, v in enumerate(_limbs(int(total)))]
            at, limb, values = (list(x) for x in zip(*whole))
            at = np.array(at)
            columns = [np.repeat(p, length)[at], np.repeat(e, length)[at], np.tile(np.arange(length), len(p))[at], np.array(limb)]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns), pa.array(np.repeat(counts[p, e], length)[at]), pa.array(values, pa.decimal128(38, 0))],
                ["part", "entry", "position", "limb", "n", "total"],
            )

    return run


def _code(shared, width: int, scale: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            errors, codes = 0, []
            for p, part in _parts(_whole(batch.column(0), width, scale), len(books)):
                code, distance = nearest(part, books[p])
                errors = errors + distance.astype(object)
                codes.append(code)
            text = [bytes(c).hex() for c in np.stack(codes, 1).astype(np.uint8)]
            error = pa.array([min(int(e), _LONGEST) for e in errors] if batch.num_rows else [], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(text, pa.string()), error], [*keep, "code", "error"])

    return run


def fit_codebooks(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> np.ndarray:
    """Codebooks (parts x entries x length of a part) after the given rounds, as integers.

    They begin as the parts of the usable vectors with the smallest ids (null ids last, ties
    by the vector's components). Each round takes all usable vectors: every entry becomes the
    floor of the mean of the parts nearest to it, or stays if there are none. Vectors
    shorter than the longest one, or than a multiple of the number of parts, count as
    filled with zeros. Without usable vectors there are no entries.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    spark = vectors.sparkSession
    read = F.col(f"`{vector}`").cast("array<double>")
    good = vectors.where(usable(F.col(f"`{vector}`")))
    longest = good.select(F.max(F.size(read))).first()[0] or 0
    width = max(1, -(-longest // parts)) * parts
    # At most `entries` rows come to the driver.
    key = F.col(f"`{vec_id}`")
    first = good.select(key.alias("id"), read.alias("v")).orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()
    start = _whole(pa.array([r.v for r in first], pa.list_(pa.float64())), width, scale)
    books = np.stack(np.split(start, parts, axis=1)) if first else np.zeros((parts, 0, width // parts), np.int64)
    for _ in range(rounds if first else 0):
        shared = spark.sparkContext.broadcast(books)
        found = good.select(read.alias("v")).mapInArrow(
            _add_up(shared, width, scale), "part long, entry long, position long, limb long, n long, total decimal(38,0)"
        )
        # parts x entries x length numbers, whatever the number of vectors.
        sums = found.groupBy("part", "entry", "position", "limb").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
        shared.unpersist()
        totals, counts = {}, {}
        for r in sums:
            key = (r.part, r.entry, r.position)
            totals[key] = totals.get(key, 0) + int(r.total) * _LIMB**r.limb
            if r.limb == 0:
                counts[key] = r.n
        books = books.astype(object)
        for key, total in totals.items():
            books[key] = total // counts[key]
        if int(abs(books).max()) < 1 << 52:
            books = books.astype(np.int64)
    return books


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, with commas between."""
    return hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()


def with_codes(vectors: DataFrame, books: np.ndarray, vector: str = "embedding", scale: int = SCALE, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all, unless named) of the usable vectors, ``code`` (two hex digits per part)
    and ``error`` (squared distances to the coded entries, added up).

    Rows whose vector is null or holds null or non-finite components are left out; vectors
    that are longer than the codebooks are refused. An error beyond a long is cut to its
    range. Columns called ``code`` or ``error`` are left out of the default.
    """
    keep = [c for c in vectors.columns if c not in ("code", "error")] if keep is None else keep
    parts, entries, length = books.shape
    quoted = [F.col(f"`{c}`") for c in keep]
    good = vectors.where(usable(F.col(f"`{vector}`")))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in vectors.select(*quoted).schema)
    schema = fields + "code string, error long"
    if not entries:
        return good.limit(0).select(*quoted, F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    rows = good.select(F.col(f"`{vector}`").cast("array<double>").alias("__vector"), *quoted)
    return rows.mapInArrow(_code(shared, parts * length, scale, keep), schema)


def compress_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", **fitting
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable vector.

    ``label_error`` is the error summed over the rows of the same label, nulls together. Null
    and repeated ids are kept as rows of their own; an empty table gives no rows. Only the
    three named columns are read, so others may have any name.
    """
    books = fit_codebooks(vectors, vec_id, vector, **fitting)
    own = vectors.select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"),
        F.col(f"`{vector}`").alias("vector"),
        # Nulls need a key of their own to be joined.
        F.coalesce(F.concat(F.lit("="), F.col(f"`{label}`").cast("string")), F.lit("")).alias("label_key"),
    )
    coded = staged(with_codes(own, books, "vector", fitting.get("scale", SCALE), ["vec_id", "label_key"]), "vector-codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONGEST).cast("decimal(38,0)")).cast("long")
    totals = staged(coded.groupBy("label_key").agg(total.alias("label_error"), F.count("*").alias("n")), "label-errors")
    found = salted_lookup(coded, totals.drop("n"), ["label_key"], "vec_id", hot=staged(largest(totals, ["label_key"], "n"), "hot-labels"))
    return found.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
