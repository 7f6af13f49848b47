"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust a score.

Four base kinds (e-mail, IPv4 address, payment card, phone number) follow fixed patterns
and checks; a base span is always reported. Context then decides about weaker proposals:
bank account numbers (IBAN, mod-97), shorter cards (13 to 15 digits, Luhn) and social
security numbers, which are reported from a score of ``MIN_SCORE`` on.

Every search is linear in the text: patterns start at the beginning of a run only, or
walk from one ``@`` to the next.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.shared import with_own_text

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
MIN_SCORE = 0.5
#: Characters before and after a span in which context words count.
CONTEXT_BEFORE, CONTEXT_AFTER = 48, 24

# Score without context by kind, and the words near a span that raise it.
START_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.7, "short card": 0.4, "ssn": 0.3}
CONTEXT_WORDS = {
    "email": ("email", "e-mail", "mail", "contact", "kontakt", "contacto", "courriel", "correo"),
    "ip": ("ip", "host", "server", "address", "login", "adresse", "servidor", "serveur"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "karte", "carte", "tarjeta", "cvv"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono", "anruf"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta", "bic", "swift"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}
CONTEXT_GAIN = 0.3

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_PART = re.compile(r"[0-9]+")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_WORDS = {kind: re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, words)) + r")(?!\w)", re.I) for kind, words in CONTEXT_WORDS.items()}
_NOT_DIGIT = re.compile(r"[^0-9]")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float
    base: bool


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The check of an international bank account number: 1 as the rest by 97."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start, step = at, 64
        while start > done:  # back over the local part, in growing steps
            low = max(done, start - step)
            start = low + len(text[low:start].rstrip(_LOCAL))
            if start > low:
                break
            step *= 2
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    for run in _DOTTED.finditer(text):
        parts = list(_PART.finditer(text, run.start(), run.end()))
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            if all(len(p := x.group().lstrip("0")) <= 3 and int(p or 0) <= 255 for x in four):
                yield four[0].start(), four[3].end()


def find_spans(text: str) -> list[Span]:
    """All spans of a text by kind in the order of ``KINDS``, then by start; offsets count code points."""
    proposed: list[tuple[str, str, int, int, bool]] = [("email", "email", s, e, True) for s, e in _emails(text)]
    proposed += [("ip", "ip", s, e, True) for s, e in _addresses(text)]
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                base = len(digits) >= 16
                proposed.append(("card", "card" if base else "short card", m.start(), m.end(), base))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                proposed.append(("phone", "phone", m.start(), m.end(), True))
    for m in _IBAN.finditer(text):
        found = m.group()
        while found:  # capitals after the number may have been taken for a part of it
            plain = found.replace(" ", "")
            if 15 <= len(plain) <= 34 and mod97(plain):
                proposed.append(("iban", "iban", m.start(), m.start() + len(found), False))
                break
            found = found.rpartition(" ")[0]
    for m in _SSN.finditer(text):
        proposed.append(("ssn", "ssn", m.start(), m.end(), False))
    spans = []
    for kind, score_of, start, end, base in proposed:
        score = START_SCORE[score_of]
        near = text[max(0, start - CONTEXT_BEFORE) : start] + "\n" + text[end : end + CONTEXT_AFTER]
        if _WORDS[kind].search(near):
            score = min(1.0, score + CONTEXT_GAIN)
        if base or score >= MIN_SCORE:
            spans.append(Span(kind, start, end, score, base))
    spans.sort(key=lambda s: (KINDS.index(s.kind), s.start))
    return spans


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping ones the longest from the first start."""
    out, upto = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= upto:
            out += [text[upto : s.start], f"[{s.kind.upper()}]"]
            upto = s.end
        elif s.end > upto:
            upto = s.end
    return "".join(out) + text[upto:]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))


def _annotate(keep: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                texts = part.column(text).to_pylist()
                found = [find_spans(t) if t else [] for t in texts]
                clean = [redact(t, f) if f else t for t, f in zip(texts, found)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in keep), pa.array([[s._asdict() for s in f] for f in found], _SPANS), pa.array(clean, pa.string())],
                    [*keep, "pii_spans", "pii_redacted"],
                )

    return run


def with_pii(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) plus ``pii_spans`` (kind, start, end, score, base) and ``pii_redacted``.

    A null text has no spans and stays null, an empty one stays empty; repeated rows are
    judged each on its own; columns of those two names in the input are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("pii_spans", "pii_redacted")]
    rows, name, fields = with_own_text(docs, keep, text)
    spans = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"
    return rows.mapInArrow(_annotate(keep, name), f"{fields}pii_spans {spans}, pii_redacted string")


def _equals(value: str):
    return lambda x: x == value


def pii_digest(found: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans as text."""
    listed = F.concat_ws(
        ",",
        F.transform("pii_spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
    )
    base = F.filter("pii_spans", lambda s: s["base"])
    base_listed = F.concat_ws(
        ",", F.transform(base, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    )
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, _equals(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(base_listed, 256).alias("base_sha256"), listed.alias("spans"))
