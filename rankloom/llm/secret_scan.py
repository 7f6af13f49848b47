"""Secrets in texts: patterns propose findings, a random forest removes the false ones.

Proposals are wide: known key formats, and any long token of mixed characters. The
forest judges each by its length and alphabet, by how usual its characters follow each
other in the corpus (trigram counts over all documents), by how much of it the corpus'
own letter groups cover, and by its path and the words around it. It is trained on
labelled findings; ``seed_labels`` labels those that are plain one way or the other, for
corpora that come without a reviewed list.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.shared import flat_bytes, pieces, small_batches, staged

MIN_LENGTH = 12
THRESHOLD = 0.5
#: Labelled findings of each kind the forest is fitted on, at most.
FIT_FINDINGS = 4_000
TREES, DEPTH, SEED = 40, 6, 11
BEFORE, AFTER = 40, 24

# Key formats, and words that speak for or against a secret.
FORMATS = {
    "cloud access key": r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    "repository token": r"gh[pousr]_[A-Za-z0-9]{36,255}",
    "chat token": r"xox[abpors]-[A-Za-z0-9-]{10,200}",
    "map key": r"AIza[0-9A-Za-z_-]{35}",
    "payment key": r"[sr]k_(?:live|test)_[0-9A-Za-z]{16,99}",
}
SECRET_WORDS = "password passwd pwd secret token apikey api_key api-key access_key private_key credential credentials auth bearer passphrase key kennwort passwort contraseña clave".split()
HARMLESS_WORDS = "example sample dummy changeme placeholder your xxxx test fake sha1 sha256 md5 checksum hash commit uuid isbn order card visa phone tel".split()
TEST_PATHS = "test tests example examples sample samples mock mocks fixture fixtures doc docs vendor".split()

_CLASS = "A-Za-z0-9+/_\\-"
_TOKEN = re.compile(rf"(?<![{_CLASS}])[{_CLASS}]{{{MIN_LENGTH},}}={{0,2}}")
_PRIVATE_KEY = re.compile(r"-----BEGIN (?:[A-Z]{1,12} ){0,3}PRIVATE KEY-----")
_SIGNED = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}")
_FORMATS = [(kind, re.compile(pattern)) for kind, pattern in FORMATS.items()]
_WORD = re.compile(r"[^\W\d_]{2,}(?:[_-][^\W\d_]+)*")
_ASSIGNED = re.compile(r"[=:]\s*[\"'`]?$")
_ALPHABET = 28
_CODE = np.zeros(256, np.int64)
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)
_CODE[48:58] = 27
FEATURES = "length entropy upper lower digit other hexadecimal transition coverage longest_word format assigned quoted secret_word harmless_word test_path path_depth runs".split()


def trigram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How often three characters (letters without case, digits as one, all else as one) follow each other, over all documents."""

    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_ALPHABET**3, np.int64)
        for batch in batches:
            data, at = flat_bytes(batch.column(0))
            for a, b in pieces(at):
                for begin in range(int(at[a]), int(at[b]), 1 << 22):
                    code = np.r_[0, _CODE[data[begin : min(int(at[b]), begin + (1 << 22))]], 0]
                    total += np.bincount((code[:-2] * _ALPHABET + code[1:-1]) * _ALPHABET + code[2:], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["place", "n"])

    counted = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(count, "place long, n long")
    out = np.zeros(_ALPHABET**3)
    for r in counted.groupBy("place").agg(F.sum("n").alias("n")).collect():  # 21,952 rows at most
        out[r["place"]] = r["n"]
    return out


def propose(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all candidates, by start; none inside another."""
    found = [("private key", m.start(), m.end()) for m in _PRIVATE_KEY.finditer(text)] if "PRIVATE KEY" in text else []
    found += [("signed token", m.start(), m.end()) for m in _SIGNED.finditer(text)] if "eyJ" in text else []
    taken: list[list[int]] = []  # what the findings so far cover, in order
    for _, start, end in sorted(found, key=lambda f: f[1]):
        if taken and start < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], end)
        else:
            taken.append([start, end])
    k = 0
    for m in _TOKEN.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        value = m.group()
        digits = any(c.isdigit() for c in value)
        mixed = len(value) >= 24 and not value[1:].islower() and not value.isupper() and value.isalpha()
        kind = next((k for k, p in _FORMATS if p.fullmatch(value)), "token")
        if (digits or mixed or kind != "token") and not (k < len(taken) and taken[k][0] < m.end()):
            found.append((kind, m.start(), m.end()))
    return sorted(found, key=lambda f: f[1:])


class Judge:
    """Turns a candidate into the forest's features."""

    def __init__(self, trigrams: np.ndarray):
        cube = trigrams.reshape(_ALPHABET, _ALPHABET, _ALPHABET)
        self.logs = np.log((cube + 0.5) / (cube.sum(2, keepdims=True) + 0.5 * _ALPHABET))
        # The letter groups that make up most of the corpus are its dictionary.
        total = max(1.0, float(trigrams.sum()))
        self.usual = (cube >= max(2.0, 2e-6 * total)) & (np.arange(_ALPHABET) % 27 != 0)[None, :, None]
        self.usual[:, 27, :] = False

    def features(self, kind: str, value: str, before: str, after: str, path: str) -> list[float]:
        n = len(value)
        codes = np.r_[0, _CODE[np.frombuffer(value.encode("ascii", "replace"), np.uint8)], 0]
        a, b, c = codes[:-2], codes[1:-1], codes[2:]
        covered = self.usual[a, b, c]
        letters = np.diff(np.flatnonzero(np.r_[True, (b == 0) | (b == 27), True])) - 1
        counts = np.unique(np.frombuffer(value.encode(), np.uint8), return_counts=True)[1] / n
        kinds = [("u" if x.isupper() else "l" if x.islower() else "d" if x.isdigit() else "o") for x in value]
        near = [w.lower() for w in _WORD.findall(before + " " + after)]
        steps = path.lower().replace("\\", "/").strip("/").split("/")
        return [
            float(min(n, 512)),
            float(-(counts * np.log2(counts)).sum()),
            kinds.count("u") / n,
            kinds.count("l") / n,
            kinds.count("d") / n,
            kinds.count("o") / n,
            float(all(x in "0123456789abcdefABCDEF" for x in value)),
            float(self.logs[a, b, c].mean()),
            float(covered.mean()),
            float(letters.max()) / n,
            float(kind != "token"),
            float(bool(_ASSIGNED.search(before))),
            float(before[-1:] in ("'", '"', "`") and after[:1] == before[-1:]),
            float(any(w in SECRET_WORDS for w in near)),
            float(any(w in HARMLESS_WORDS for w in near)),
            float(any(w in TEST_PATHS for w in re.split(r"[^a-z]+", path.lower()))),
            float(len(steps)),
            sum(x != y for x, y in zip(kinds, kinds[1:])) / n,
        ]


def find_candidates(docs: DataFrame, trigrams: np.ndarray, text: str = "text", doc_id: str = "doc_id", path: str = "source") -> DataFrame:
    """(doc_id, kind, start, end, value, features) for each candidate; offsets count code points."""
    shared = docs.sparkSession.sparkContext.broadcast(trigrams)
    schema = pa.schema([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("features", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                rows, owners = [], []
                for i, (text, where) in enumerate(zip(part.column("__text").to_pylist(), part.column("__path").to_pylist())):
                    for kind, s, e in propose(text or ""):
                        features = judge.features(kind, text[s:e], text[max(0, s - BEFORE) : s], text[e : e + AFTER], where or "")
                        rows.append((kind, s, e, text[s:e], features))
                        owners.append(i)
                columns = [pa.array(v, f.type) for v, f in zip(list(zip(*rows)) or [()] * 5, schema)]
                yield pa.RecordBatch.from_arrays([part.column("__id").take(pa.array(owners, pa.int64())), *columns], [doc_id, *schema.names])

    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"), F.col(path).cast("string").alias("__path"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return rows.mapInArrow(run, f"`{doc_id}` {kind}, kind string, start long, end long, value string, features array<double>")


def _feature(name: str) -> Column:
    return F.element_at("features", FEATURES.index(name) + 1)


def seed_labels(findings: DataFrame) -> DataFrame:
    """``label`` for findings that are plain: known formats and assigned values next to a word such as
    password are secrets; plain numbers, words and examples are not. The others get null."""
    secret = (F.col("kind") != "token") | ((_feature("secret_word") == 1) & (_feature("assigned") == 1) & (_feature("entropy") >= 2.5))
    harmless = (_feature("digit") == 1) | (_feature("harmless_word") == 1) | (_feature("coverage") >= 0.6)
    label = F.when(harmless & (F.col("kind") == "token"), 0.0).when(secret, 1.0)
    return findings.withColumn("label", label)


def fit_forest(labelled: DataFrame, doc_id: str = "doc_id", most: int = FIT_FINDINGS) -> RandomForestClassificationModel | None:
    """A forest from findings with a ``label`` of 0 or 1 (null: not used); None if one of them is missing.

    Of each label at most ``most`` findings are used, those with the smallest hashes."""
    turn = [F.xxhash64(doc_id, "start"), F.col(doc_id), F.col("start"), F.col("value")]
    parts = [labelled.where(F.col("label") == y).orderBy(*turn).limit(most) for y in (0.0, 1.0)]
    rows = staged(parts[0].unionByName(parts[1]).select("label", array_to_vector("features").alias("vector")), "labelled-findings")
    if rows.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.8)
    return forest.fit(rows)


def judged(findings: DataFrame, model: RandomForestClassificationModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """Findings with ``score`` (the forest's share of votes for a secret) and ``is_secret``. Without a
    forest, formats and assigned values count as secrets."""
    if model is None:
        found = seed_labels(findings).withColumn("score", F.coalesce("label", F.lit(0.0))).drop("label")
    else:
        voted = model.transform(findings.withColumn("vector", array_to_vector("features")))
        found = voted.withColumn("score", vector_to_array("probability")[1]).drop("vector", "rawPrediction", "probability", "prediction")
    return found.withColumn("is_secret", F.col("score") >= threshold)


def scan(docs: DataFrame, train_on: Column, text: str = "text", doc_id: str = "doc_id", path: str = "source", labelled: DataFrame | None = None) -> DataFrame:
    """All findings of the documents with score and decision.

    ``labelled``: reviewed findings with ``label`` and ``features``; by default the seed
    labels of the documents chosen by ``train_on``. Null and empty texts have no findings; a null
    path counts as none; repeated documents are scanned each on its own.
    """
    findings = find_candidates(docs, trigram_counts(docs, text), text, doc_id, path)
    findings = staged(findings, "secret-candidates")
    model = fit_forest(seed_labels(findings.where(train_on)) if labelled is None else labelled, doc_id)
    return judged(findings, model)
