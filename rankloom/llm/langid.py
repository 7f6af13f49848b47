"""Language of texts with mixed languages: scripts narrow the candidates, Viterbi labels the words.

A model holds, for each language, the log probability of hashed byte trigrams of words
(with marks for their ends) and the share of scripts its letters are in. A word is
scored under every language that uses its script; a path through the words of a text
pays a penalty for each change of language, and the best path (Viterbi) gives spans.
The texts of a batch go through the recursion together, one word of each at a step.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.shared import flat_bytes, pieces, small_batches

BUCKET_BITS = 15
SWITCH_PENALTY = 12.0
#: Labelled documents that the model is fitted on, by language, at most about this many.
FIT_ROWS = 3_000
#: Bits of the hashes that decide on the sample: fine enough for any number of texts.
TURN_BITS = 60
#: A language may be a word's if at least this share of its training letters is in the word's script.
SCRIPT_SHARE = 0.005
UNKNOWN = "und"
_OTHER_SCRIPT = -50.0
_PATH_BYTES = 1 << 24

# Scripts, and the first bytes of their characters in UTF-8.
SCRIPTS = {
    "latin": [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)],
    "greek": [0xCD, 0xCE, 0xCF],
    "cyrillic": [0xD0, 0xD1, 0xD2, 0xD3],
    "armenian and hebrew": [0xD4, 0xD5, 0xD6, 0xD7],
    "arabic": [0xD8, 0xD9, 0xDA, 0xDB],
    "indic and south-east asian": [0xE0],
    "georgian, hangul letters and others": [0xE1],
    "kana": [0xE3],
    "han": [0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9],
    "hangul": [0xEA, 0xEB, 0xEC, 0xED],
}
_N_SCRIPTS = len(SCRIPTS) + 1  # the last stands for all else
_SCRIPT = np.full(256, _N_SCRIPTS - 1, np.int64)
for _k, _bytes in enumerate(SCRIPTS.values()):
    _SCRIPT[_bytes] = _k
_LETTER = np.array([chr(c).isalpha() if c < 128 else True for c in range(256)])
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


class Model(NamedTuple):
    languages: list[str]
    scores: np.ndarray  # language x bucket, float32
    allowed: np.ndarray  # script x language


def _letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowered bytes with 0 outside words (A-Z, a-z and all non-ASCII), and which are inside."""
    inside = _LETTER[data]
    lower = np.where(inside, _LOWER[data], 0).astype(np.uint8)
    # Capital letters of Latin-1: their second byte is 32 below that of the small ones.
    second = np.flatnonzero((lower[1:] >= 0x80) & (lower[1:] <= 0x9E) & (lower[:-1] == 0xC3)) + 1
    lower[second] += 32
    return lower, inside


def _trigrams(lower: np.ndarray) -> np.ndarray:
    """A bucket for each byte with its neighbours."""
    x = lower.astype(np.uint32)
    before, after = np.r_[np.uint32(0), x[:-1]], np.r_[x[1:], np.uint32(0)]
    h = (before * np.uint32(0x01000193) + x) * np.uint32(0x85EBCA6B) + after * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def _joined(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a space after each, so that no word goes over a text's end."""
    n = len(offsets) - 1
    out = np.full(len(data) + n, 32, np.uint8)
    place = np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))
    out[place] = data
    return out, offsets + np.arange(n + 1)


def _words(data: np.ndarray, offsets: np.ndarray):
    """Lowered bytes, begin and end of each word, and where each text's words begin."""
    spaced, at = _joined(data, offsets)
    lower, inside = _letters(spaced)
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    begin, end = edge[0::2], edge[1::2]
    return lower, begin, end, np.searchsorted(begin, at)


def word_scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words x languages scores, letters (bytes) of each word, and where each text's words begin."""
    lower, begin, end, first = _words(data, offsets)
    n = len(begin)
    scores = np.zeros((n, len(model.languages)), np.float32)
    if n:
        buckets = _trigrams(lower)
        edges = np.stack([begin, end], 1).ravel()
        for k in range(len(model.languages)):
            # Every second stretch is what lies between two words.
            scores[:, k] = np.add.reduceat(np.append(model.scores[k][buckets], np.float32(0)), edges)[::2]
        scores -= scores.max(1, keepdims=True)
        able = model.allowed[_SCRIPT[lower[begin]]]
        scores[~able & able.any(1, keepdims=True)] += _OTHER_SCRIPT
    return scores, end - begin, first


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The language of each word on the best path of each text; ties stay, then go to the first language."""
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = first[:-1][order], lengths[order]
    longest = int(lengths[0]) if len(lengths) else 0
    n_languages = scores.shape[1]
    number = np.min_scalar_type(n_languages)
    came = np.zeros((len(scores), n_languages), number)
    best = np.zeros((len(order), n_languages), np.float32)
    active = np.searchsorted(-lengths, -np.arange(longest), "left")  # texts with more than t words
    own = np.arange(n_languages, dtype=number)
    for t in range(longest):
        a = active[t]
        at = starts[:a] + t
        if t:
            value = best[:a]
            top = value.argmax(1)
            change = value[np.arange(a), top][:, None] - np.float32(penalty)
            stays = value >= change
            came[at] = np.where(stays, own, top[:, None].astype(number))
            best[:a] = np.where(stays, value, change) + scores[at]
        else:
            best[:a] = scores[at]
    label = np.zeros(len(scores), number)
    state = best.argmax(1)
    for t in range(longest - 1, -1, -1):
        a = active[t]
        at = starts[:a] + t
        label[at] = state[:a]
        if t:
            state[:a] = came[at, state[:a]]
    return label


def _has_letter(data: np.ndarray) -> bool:
    ascii_letter = _LETTER[data] & (data < 128)
    return bool(ascii_letter.any()) or (bool((data >= 128).any()) and any(c.isalpha() for c in data.tobytes().decode("utf-8", "ignore")))


def _label(shared, penalty: float, keep: list[str]):
    spans_type = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())]))

    def of_texts(model: Model, data: np.ndarray, at: np.ndarray):
        parts = [word_scores(model, data[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in pieces(at)]
        scores = np.concatenate([p[0] for p in parts])
        letters = np.concatenate([p[1] for p in parts])
        n_words = np.concatenate([np.diff(p[2]) for p in parts])
        first = np.r_[0, np.cumsum(n_words)]
        labels = viterbi(scores, first, penalty)
        for i in range(len(at) - 1):
            own, size = labels[first[i] : first[i + 1]], letters[first[i] : first[i + 1]]
            if not len(own) or not _has_letter(data[at[i] : at[i + 1]]):
                yield UNKNOWN, 0.0, []
                continue
            share = np.bincount(own, size, len(model.languages)) / size.sum()
            change = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            runs = np.diff(np.r_[change, len(own)])
            k = int(share.argmax())
            yield model.languages[k], float(share[k]), [{"lang": model.languages[own[c]], "words": int(n)} for c, n in zip(change, runs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            offsets = flat_bytes(whole.column("__text"))[1]
            for a, b in pieces(offsets, _PATH_BYTES):
                batch = whole.slice(a, b - a)
                data, at = flat_bytes(batch.column("__text"))
                rows = list(of_texts(model, data, at)) if model.languages else [(UNKNOWN, 0.0, [])] * (b - a)
                names, scores, spans = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, spans_type)],
                    [*keep, "lang_pred", "score", "lang_spans"],
                )

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, place, n): trigrams by bucket and letters by script, summed over the partition."""
    grams: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for batch in batches:
        data, at = flat_bytes(batch.column("__text"))
        for i, lang in enumerate(batch.column("__lang").to_pylist()):
            text = data[at[i] : at[i + 1]]
            for begin in range(0, len(text), 1 << 22):
                lower, first, end, _ = _words(text[begin : begin + (1 << 22)], np.array([0, len(text[begin : begin + (1 << 22)])]))
                n = np.bincount(_trigrams(lower)[lower > 0], minlength=1 << BUCKET_BITS)
                grams[lang] = grams.get(lang, 0) + n
                scripts[lang] = scripts.get(lang, 0) + np.bincount(_SCRIPT[lower[first]], end - first, _N_SCRIPTS)
    for kind, counts in enumerate((grams, scripts)):
        for lang, n in counts.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(some)), pa.array(np.full(len(some), kind, np.int32)), pa.array(some), pa.array(n[some].astype(np.int64))],
                ["lang", "kind", "place", "n"],
            )


def fit(labelled: DataFrame, text: str, lang: str, key: Column, rows: int = FIT_ROWS, partitions: int = 8) -> Model:
    """A model from labelled texts. About ``rows`` documents a language are used, those with the
    smallest hashes of ``key``; null labels and texts are left out. The model is 128 KB a
    language."""
    spark = labelled.sparkSession
    some = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    some = some.select(F.col(lang).cast("string").alias("__lang"), F.col(text).alias("__text"), F.shiftrightunsigned(F.xxhash64(key), 64 - TURN_BITS).alias("__turn"))
    sizes = {r["__lang"]: r["count"] for r in some.groupBy("__lang").count().collect()}
    parts = spark.createDataFrame([(n, min(rows, size) * (1 << TURN_BITS) // size) for n, size in sizes.items()], "__lang string, __most long")
    chosen = some.join(F.broadcast(parts), "__lang").where(F.col("__turn") < F.col("__most")).select("__lang", "__text")
    counted = chosen.repartition(partitions).mapInArrow(_count, "lang string, kind int, place long, n long")
    languages = sorted(sizes)
    grams = np.full((len(languages), 1 << BUCKET_BITS), 0.5)
    scripts = np.zeros((_N_SCRIPTS, len(languages)))
    found = counted.groupBy("lang", "kind", "place").agg(F.sum("n").alias("n")).toPandas()
    at = np.array([languages.index(x) for x in found["lang"]], np.int64)
    gram = (found["kind"] == 0).to_numpy()
    grams[at[gram], found["place"].to_numpy()[gram]] += found["n"].to_numpy()[gram]
    scripts[found["place"].to_numpy()[~gram], at[~gram]] += found["n"].to_numpy()[~gram]
    scores = np.log(grams / grams.sum(1, keepdims=True)) if languages else grams
    return Model(languages, scores.astype(np.float32), scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1))


def with_language(docs: DataFrame, model: Model, text: str = "text", penalty: float = SWITCH_PENALTY, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) plus ``lang_pred`` (the language with most letters on the
    best path), ``score`` (its share of the letters) and ``lang_spans`` (language, words).

    Null, empty and letterless texts are ``und`` with score 0 and no spans; without a
    learned language all are. Repeated rows are judged each on its own; input columns
    with the names of the results are replaced.
    """
    new = ("lang_pred", "score", "lang_spans")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    small_batches(docs.sparkSession)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(text), F.lit("")).alias("__text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.drop("__text").schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_label(shared, penalty, keep), f"{fields}lang_pred string, score double, lang_spans array<struct<lang:string,words:bigint>>")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
