"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word goes in as vectors of the word itself, of its characters (its byte 4-grams with
marks for the ends) and of its beginnings of several lengths, all hashed. A forward and a backward recurrent layer
run over windows of words, attention weighs the positions, and a window gets a logit.
All overlapping windows of a text are scored; the text's score is its highest logit,
calibrated on the training documents.

Documents carry labels, windows do not: the first stage of the training takes every
window of a toxic document as toxic, the later ones only those that stand out from the clean documents'.
Word and character vectors start from log odds in their first dimension.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.langid import _LETTER, _joined, _letters
from rankloom.llm.shared import flat_bytes, pieces, with_own_text

WINDOW, STRIDE = 32, 16
HIDDEN, ATTENTION = 8, 8
#: Numbers of the vectors' components, and bits of the hashes.
SIZES = {"word": 4, "char": 8, "start": 4}
BITS = {"word": 20, "char": 18, "start": 20}
#: Places in a word (bytes) whose 4-gram ends a beginning that gets a vector.
STARTS = (2, 4, 6)
THRESHOLD = 0.7
#: Labelled documents the model is fitted on, at most, and the length above which a text is not among them.
FIT_TOXIC, FIT_CLEAN, FIT_TEXT_BYTES = 800, 1_600, 20_000
STAGES, STEPS, BATCH, RATE, SEED = 3, 160, 256, 0.01, 7
#: Words and 4-grams of fewer training documents have no vector.
MIN_DOCS = 4
#: Toxic texts that the score is calibrated on, at least, where there are as many.
CALIBRATE_TOXIC = 64
#: Bytes that are cut into words at once; a single text of over twice as many goes by stretches.
_SCORE_PIECE = 1 << 18

Model = dict[str, np.ndarray]


class Tokens(NamedTuple):
    word: np.ndarray  # a bucket for each word
    start: np.ndarray  # words x STARTS
    char: np.ndarray  # buckets of the words' 4-grams
    first_char: np.ndarray  # where each word's begin (n + 1)
    first_word: np.ndarray  # where each text's words begin (n + 1)

    def stretch(self, low: int, high: int) -> Tokens:
        """The words from one to before another, as one text."""
        begin, end = self.first_char[low], self.first_char[high]
        return Tokens(self.word[low:high], self.start[low:high], self.char[begin:end], self.first_char[low : high + 1] - begin, np.array([0, high - low]))

    def some(self, words: np.ndarray) -> Tokens:
        """Only these words, as one text."""
        sizes = np.diff(self.first_char)[words]
        first = np.r_[0, np.cumsum(sizes)]
        chars = np.repeat(self.first_char[words], sizes) + np.arange(first[-1]) - np.repeat(first[:-1], sizes)
        return Tokens(self.word[words], self.start[words], self.char[chars], first, np.array([0, len(words)]))

    def then(self, t: Tokens) -> Tokens:
        """The words of this text and of another one, as one text."""
        first = np.r_[self.first_char, self.first_char[-1] + t.first_char[1:]]
        joined = (np.concatenate(x) for x in zip(self[:3], t[:3]))
        return Tokens(*joined, first, np.array([0, len(self.word) + len(t.word)]))


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    """The words of some texts: runs of letters, lowered; immediate repeats of a word count once.

    Every byte of a word starts one 4-gram that begins a byte before it."""
    spaced, at = _joined(data, offsets)
    lower, inside = _letters(spaced)
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    begin, end = edge[0::2], edge[1::2]
    x = np.r_[np.uint32(0), lower.astype(np.uint32), np.uint32(0), np.uint32(0)]
    after = np.where(x[2:-1] == 0, 0, x[3:]).astype(np.uint32)
    gram = x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16) | after << np.uint32(24)
    gram = (gram * np.uint32(0x9E3779B1)) ^ ((gram * np.uint32(0x85EBCA6B)) >> np.uint32(15))
    gram = (gram * np.uint32(0x2C1B3C6D))[inside]
    first_char = np.r_[0, np.cumsum(end - begin)]
    # A hash of a word's beginning up to a place: its 4-grams with their places, summed.
    place = (np.arange(len(gram)) - np.repeat(first_char[:-1], np.diff(first_char))).astype(np.uint64)
    mixed = gram.astype(np.uint64) * (2 * place + np.uint64(0x9E3779B97F4A7C15))
    total = np.r_[np.uint64(0), np.cumsum(mixed, dtype=np.uint64)]
    upto = lambda stop: (total[stop] - total[first_char[:-1]]) * np.uint64(0xBF58476D1CE4E5B9)
    whole = upto(first_char[1:])
    first_word = np.searchsorted(begin, at)
    again = np.zeros(len(whole), bool)
    again[1:] = whole[1:] == whole[:-1]
    again[first_word[:-1][first_word[:-1] < len(whole)]] = False
    starts = np.stack([upto(np.minimum(first_char[:-1] + k + 1, first_char[1:])) for k in STARTS], 1)
    found = Tokens(
        (whole >> np.uint64(64 - BITS["word"])).astype(np.int32),
        (starts >> np.uint64(64 - BITS["start"])).astype(np.int32),
        (gram >> np.uint32(32 - BITS["char"])).astype(np.int32),
        first_char,
        first_word,
    )
    if again.any():
        kept = np.flatnonzero(~again)
        found = found.some(kept)._replace(first_word=np.searchsorted(kept, first_word))
    return found


def tokens_of(texts: list[bytes]) -> Tokens:
    """The tokens of many texts, made from some of them at a time."""
    offsets, parts = np.r_[0, np.cumsum([len(x) for x in texts])].astype(np.int64), []
    for a, b in pieces(offsets, _SCORE_PIECE):
        parts.append(tokens(np.frombuffer(b"".join(texts[a:b]), np.uint8), offsets[a : b + 1] - offsets[a]))
    joined = [np.concatenate(x) for x in list(zip(*parts))[:3]]
    sizes = [np.concatenate([np.diff(x) for x in y]) for y in list(zip(*parts))[3:]]
    return Tokens(*joined, *(np.r_[0, np.cumsum(x)] for x in sizes))


def windows_of(n_words: np.ndarray, window: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and length of all windows; the last of a text ends with it, texts without words have none."""
    count = np.where(n_words == 0, 0, np.where(n_words <= window, 1, -(-(n_words - window) // stride) + 1))
    text = np.repeat(np.arange(len(n_words)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    first = np.minimum(k * stride, np.maximum(n_words[text] - window, 0))
    return text, first, np.minimum(n_words[text], window)


def rows_of(model: Model, t: Tokens) -> dict[str, np.ndarray]:
    """Rows of the vectors for what the tokens consist of; row 0 is for what training did not see often."""
    return {name: model[f"{name}_rows"].take(getattr(t, name)) for name in SIZES}


def inputs(model: Model, t: Tokens) -> np.ndarray:
    """A row for each word: its own vector, the scaled sum of its characters', the mean of its beginnings'."""
    out = np.zeros((len(t.word), sum(SIZES.values())), np.float32)
    if len(t.word):
        rows, at = rows_of(model, t), SIZES["word"]
        out[:, :at] = model["word"].take(rows["word"], 0)
        scale = 1.0 / np.sqrt(np.diff(t.first_char).astype(np.float32))
        for d in range(SIZES["char"]):
            out[:, at + d] = np.add.reduceat(model["char"][:, d].take(rows["char"]), t.first_char[:-1]) * scale
        at += SIZES["char"]
        for k in range(len(STARTS)):
            out[:, at:] += model["start"].take(rows["start"][:, k], 0) / np.float32(len(STARTS))
    return out


def _input_gradients(model: Model, t: Tokens, d_x: np.ndarray) -> Model:
    rows, at = rows_of(model, t), SIZES["word"]
    out = {name: np.zeros_like(model[name]) for name in SIZES}
    np.add.at(out["word"], rows["word"], d_x[:, :at])
    sizes = np.diff(t.first_char)
    d_chars = np.repeat(d_x[:, at : at + SIZES["char"]] / np.sqrt(sizes)[:, None], sizes, 0).astype(np.float32)
    np.add.at(out["char"], rows["char"], d_chars)
    for k in range(len(STARTS)):
        np.add.at(out["start"], rows["start"][:, k], d_x[:, at + SIZES["char"] :] / np.float32(len(STARTS)))
    for g in out.values():
        g[0] = 0
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def forward(model: Model, x: np.ndarray, index: np.ndarray, mask: np.ndarray | None, trace: dict | None = None) -> np.ndarray:
    """Logits of windows. ``index``: windows x positions into the rows of ``x``; ``mask``: 1 where there is a word."""
    n, length = index.shape
    h_size = HIDDEN
    gates = np.stack([x @ model["Wx"][d] + model["bx"][d] for d in range(2)])  # direction, word, 3 * hidden
    h = np.zeros((2, n, h_size), np.float32)
    states = np.empty((length, 2, n, h_size), np.float32)
    steps = []
    for t in range(length):
        at = (index[:, t], index[:, length - 1 - t])
        g = np.stack([gates[0].take(at[0], 0), gates[1].take(at[1], 0)])
        u = np.matmul(h, model["U"])
        zr = _sigmoid(g[:, :, : 2 * h_size] + u[:, :, : 2 * h_size])
        z, r = zr[:, :, :h_size], zr[:, :, h_size:]
        candidate = np.tanh(g[:, :, 2 * h_size :] + r * u[:, :, 2 * h_size :])
        new = candidate + z * (h - candidate)
        if mask is not None:
            m = np.stack([mask[:, t], mask[:, length - 1 - t]])[:, :, None]
            new = m * new + (1 - m) * h
        if trace is not None:
            steps.append((h, z, r, candidate, u[:, :, 2 * h_size :]))
        h = new
        states[t, 0], states[length - 1 - t, 1] = h[0], h[1]
    both = states.transpose(2, 0, 1, 3).reshape(n, length, 2 * h_size)
    hidden = np.tanh(both @ model["Wa"] + model["ba"])
    weight = hidden @ model["va"]
    if mask is not None:
        weight = np.where(mask > 0, weight, -1e9)
    weight = np.exp(weight - weight.max(1, keepdims=True))
    weight /= weight.sum(1, keepdims=True)
    pooled = np.einsum("nt,nth->nh", weight, both)
    if trace is not None:
        trace.update(steps=steps, both=both, hidden=hidden, weight=weight, pooled=pooled)
    return pooled @ model["wo"] + model["bo"]


def gradients(model: Model, x: np.ndarray, index: np.ndarray, mask: np.ndarray, d_logit: np.ndarray, trace: dict) -> tuple[Model, np.ndarray]:
    """Gradients of the dense weights and of the input rows."""
    n, length = index.shape
    h_size = HIDDEN
    both, hidden, weight, pooled = trace["both"], trace["hidden"], trace["weight"], trace["pooled"]
    out = {"wo": pooled.T @ d_logit, "bo": d_logit.sum(keepdims=True)}
    d_pooled = d_logit[:, None] * model["wo"]
    d_both = weight[:, :, None] * d_pooled[:, None, :]
    d_weight = np.einsum("nth,nh->nt", both, d_pooled)
    d_score = weight * (d_weight - (weight * d_weight).sum(1, keepdims=True))
    out["va"] = np.einsum("nt,nta->a", d_score, hidden)
    d_hidden = d_score[:, :, None] * model["va"] * (1 - hidden**2)
    out["Wa"] = both.reshape(n * length, -1).T @ d_hidden.reshape(n * length, -1)
    out["ba"] = d_hidden.sum((0, 1))
    d_both += d_hidden @ model["Wa"].T
    d_states = d_both.reshape(n, length, 2, h_size).transpose(1, 2, 0, 3)
    d_gates = np.zeros((2, len(x), 3 * h_size), np.float32)
    d_u = np.zeros_like(model["U"])
    d_h = np.zeros((2, n, h_size), np.float32)
    for t in range(length - 1, -1, -1):
        h, z, r, candidate, u_n = trace["steps"][t]
        d_new = d_h + np.stack([d_states[t, 0], d_states[length - 1 - t, 1]])
        m = np.stack([mask[:, t], mask[:, length - 1 - t]])[:, :, None]
        d_out = d_new * m
        d_c = d_out * (1 - z) * (1 - candidate**2)
        d_z = d_out * (h - candidate) * z * (1 - z)
        d_r = d_c * u_n * r * (1 - r)
        d_g = np.concatenate([d_z, d_r, d_c * r], 2)
        d_h = d_out * z + d_new * (1 - m) + np.matmul(d_g, model["U"].transpose(0, 2, 1))
        d_u += np.matmul(h.transpose(0, 2, 1), d_g)
        d_in = np.concatenate([d_z, d_r, d_c], 2)
        np.add.at(d_gates[0], index[:, t], d_in[0])
        np.add.at(d_gates[1], index[:, length - 1 - t], d_in[1])
    out["U"] = d_u
    out["Wx"] = np.stack([x.T @ d_gates[d] for d in range(2)])
    out["bx"] = d_gates.sum(1)
    d_x = d_gates[0] @ model["Wx"][0].T + d_gates[1] @ model["Wx"][1].T
    return out, d_x


def _start(t: Tokens, doc_of_word: np.ndarray, labels: np.ndarray, rng) -> Model:
    """First weights; only what ``MIN_DOCS`` documents have gets a vector, and begins with its log odds."""
    n_toxic, n_clean = max(1, int((labels == 1).sum())), max(1, int((labels == 0).sum()))
    d, h = sum(SIZES.values()), HIDDEN
    normal = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
    model = {
        "Wx": normal(2, d, 3 * h) / np.sqrt(d), "bx": np.zeros((2, 3 * h), np.float32), "U": normal(2, h, 3 * h) / np.sqrt(h),
        "Wa": normal(2 * h, ATTENTION) / np.sqrt(2 * h), "ba": np.zeros(ATTENTION, np.float32), "va": normal(ATTENTION) / np.sqrt(ATTENTION),
        "wo": normal(2 * h) / np.sqrt(2 * h), "bo": np.zeros(1, np.float32),
    }
    model = {k: v.astype(np.float32) for k, v in model.items()}
    counts = {name: np.zeros((2, 1 << BITS[name]), np.int32) for name in SIZES}
    for begin in range(0, len(t.word), 1 << 16):
        # Whole documents: from the first that begins in this stretch of words to the next stretch's first.
        low, high = (np.searchsorted(doc_of_word, doc_of_word[min(k, len(t.word) - 1)] if k < len(t.word) else np.iinfo(np.int64).max) for k in (begin, begin + (1 << 16)))
        if low >= high:
            continue
        part, docs = t.stretch(low, high), doc_of_word[low:high]
        owners = {"word": docs, "char": np.repeat(docs, np.diff(part.first_char)), "start": np.repeat(docs, len(STARTS))}
        for name in SIZES:
            n = 1 << BITS[name]
            seen = np.unique(owners[name].astype(np.int64) * n + getattr(part, name).ravel())  # a document counts once
            for label in (0, 1):
                np.add.at(counts[name][label], seen[labels[seen // n] == label] % n, 1)
    for name, size in SIZES.items():
        clean, toxic = counts[name]
        often = np.flatnonzero(toxic + clean >= MIN_DOCS)
        odds = np.log((toxic[often] + 1) / (n_toxic + 2)) - np.log((clean[often] + 1) / (n_clean + 2))
        both = (toxic + clean)[often]
        vectors = np.zeros((len(often) + 1, size), np.float32)
        vectors[1:] = 0.05 * normal(len(often), size)
        vectors[1:, 0] = 0.5 * np.clip(odds, -4, 4) * both / (both + MIN_DOCS)
        rows = np.zeros(len(clean), np.int32)
        rows[often] = np.arange(1, len(often) + 1)
        model[name], model[f"{name}_rows"] = vectors, rows
    return model


def _index(first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of windows in the words, those past a short window at its last word, and the mask."""
    t = np.arange(int(length.max()) if len(length) else 0)
    mask = (t[None, :] < length[:, None]).astype(np.float32)
    return first[:, None] + np.minimum(t[None, :], length[:, None] - 1), mask


def logits(model: Model, t: Tokens, first: np.ndarray, length: np.ndarray, batch: int = 1_024) -> np.ndarray:
    """``first`` ascends, so a batch of full windows needs one stretch of words; short ones are far apart."""
    out = np.empty(len(first), np.float32)
    full = length == WINDOW
    for some in (np.flatnonzero(full), np.flatnonzero(~full)):
        for k in range(0, len(some), batch):
            part = some[k : k + batch]
            index, mask = _index(first[part], length[part])
            low, high = int(index.min()), int(index.max()) + 1
            if high - low <= 2 * index.size:
                own, place = t.stretch(low, high), index - low
            else:
                words, place = np.unique(index, return_inverse=True)
                own, place = t.some(words), place.reshape(index.shape)
            out[part] = forward(model, inputs(model, own), place, None if mask.all() else mask)
    return out


def train(texts: list[bytes], labels: np.ndarray, stages: int = STAGES, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> Model:
    """A model from whole labelled texts. One of the labels may be missing, or all texts.

    Every fourth text of each label is kept back: its windows are not trained on, and the
    score is calibrated on it. Quarters take turns until ``CALIBRATE_TOXIC`` toxic texts are
    calibrated on; if all four have had theirs, the model is trained once more, on all texts."""
    t = tokens_of(texts or [b""])
    labels = labels if len(texts) else np.zeros(1, np.int64)
    learn = lambda back: _learn(t, labels, back, stages, steps, batch, rate, np.random.default_rng(seed))
    kinds = [np.flatnonzero(labels == kind) for kind in (0, 1)]
    tested, found = np.zeros(len(labels), bool), np.zeros(len(labels))
    model, whole = None, np.zeros(len(labels), bool)
    if min(map(len, kinds)) >= 4:
        for turn in range(3, -1, -1):
            back = np.zeros(len(labels), bool)
            back[np.concatenate([kind[turn::4] for kind in kinds])] = True
            model = learn(back)
            found[back] = document_logits(model, t)[back]
            tested |= back
            if (tested & (labels == 1)).sum() >= CALIBRATE_TOXIC:
                break
        else:
            model = learn(whole)
    else:
        model = learn(whole)
        tested, found = ~whole, document_logits(model, t)
    model["calibration"] = _calibrate(found[tested], labels[tested])
    return model


def _learn(t: Tokens, labels: np.ndarray, back: np.ndarray, stages: int, steps: int, batch: int, rate: float, rng) -> Model:
    """A model from the windows of the texts that are not kept back."""
    n_words = np.diff(t.first_word)
    doc_of_word = np.repeat(np.arange(len(n_words)), n_words)
    model = _start(t, doc_of_word, np.where(back, -1, labels), rng)
    text, first, length = windows_of(n_words, WINDOW, WINDOW)
    text, first, length = text[~back[text]], first[~back[text]], length[~back[text]]
    first = first + t.first_word[text]
    target = labels[text].astype(np.float32)
    used = np.arange(len(text))
    learned = [k for k in model if not k.endswith("_rows")]
    mean, square = ({k: np.zeros_like(model[k]) for k in learned} for _ in range(2))
    step = 0
    for stage in range(stages):
        if stage and (target == 1).any() and (target == 0).any():
            own = logits(model, t, first, length)
            bar = np.quantile(own[target == 0], 0.98)
            best = np.full(len(n_words), -np.inf, np.float32)
            np.maximum.at(best, text, own)
            used = np.flatnonzero((target == 0) | (own > bar) | (own == best[text]))
        share = max(1e-6, float(target[used].mean())) if len(used) else 0.5
        rounds = -(-steps * batch // max(1, len(used)))
        order = np.concatenate([rng.permutation(used) for _ in range(rounds)])[: steps * batch]
        for part in np.array_split(order, steps):
            if not len(part):
                continue
            # The batch's own words, so that arrays stay small.
            index, mask = _index(first[part], length[part])
            some, place = np.unique(index, return_inverse=True)
            place = place.reshape(index.shape)
            part_tokens, trace = t.some(some), {}
            x = inputs(model, part_tokens)
            p = _sigmoid(forward(model, x, place, mask, trace))
            y = target[part]
            weight = np.where(y == 1, 0.5 / share, 0.5 / max(1e-6, 1 - share)).astype(np.float32)
            grads, d_x = gradients(model, x, place, mask, ((p - y) * weight / len(part)).astype(np.float32), trace)
            grads.update(_input_gradients(model, part_tokens, d_x))
            step += 1
            slow = rate * min(1.0, step / 20) * (0.3 if stage == stages - 1 else 1.0)
            for k, g in grads.items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.001 * (g * g - square[k])
                model[k] -= (slow * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def document_logits(model: Model, t: Tokens) -> np.ndarray:
    """The highest logit over all overlapping windows of each text; minus infinity without words."""
    text, first, length = windows_of(np.diff(t.first_word))
    out = np.full(len(t.first_word) - 1, -np.inf)
    np.maximum.at(out, text, logits(model, t, first + t.first_word[text], length))
    return out


def _stretches(data: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, bool]]:
    """A text in stretches of about ``limit`` bytes, and whether it is the last one. A stretch ends
    after a whole word, and the next one begins with that word again."""
    low, high, n = 0, 0, len(data)
    while high < n:
        high = min(n, high + limit)
        while high < n:
            gap = np.flatnonzero(~_LETTER[data[high : high + limit]])
            if len(gap):
                high += int(gap[0])
                break
            high = min(n, high + limit)
        inside = _LETTER[data[low:high]]
        begin = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
        if high == n or len(begin) > 1:
            yield data[low:high], high == n
            low += int(begin[-1]) if len(begin) else 0


def long_text_logit(model: Model, data: np.ndarray, limit: int = _SCORE_PIECE) -> float:
    """As ``document_logits``, the same windows of one text, in memory that its length does not add to."""
    best, held = -np.inf, None
    for part, last in _stretches(data, limit):
        t = tokens(part, np.array([0, len(part)]))
        if held is not None:  # the first word is the last one held
            t = held.then(t.stretch(1, len(t.word)))
        n = len(t.word)
        whole = t if last else t.stretch(0, n - (n - WINDOW) % STRIDE if n >= WINDOW else 0)
        best = max(best, float(document_logits(model, whole)[0]))
        # The words of the last whole window stay: the text may end with the next word.
        held = t.stretch(max(0, len(whole.word) - WINDOW), n)
    return best


def _calibrate(found: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Slope and shift of a logistic curve over the document logits.

    The curve is then moved so that it passes the threshold where misses and false alarms cost
    least: a few toxic texts of unknown words would else draw it below the threshold for all."""
    known = np.isfinite(found)
    x, y = found[known].astype(np.float64), labels[known].astype(np.float64)
    a, b = 1.0, 0.0
    if not len(x) or y.min() == y.max():
        return np.array([a, b])
    center, spread = x.mean(), x.std() or 1.0
    x = (x - center) / spread
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        v = p * (1 - p)
        g = np.array([((p - y) * x).sum() + 1e-2 * a, (p - y).sum()])
        hess = np.array([[(v * x * x).sum() + 1e-2, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(hess, g), -1, 1)
    if a > 0:
        order = np.argsort(-x, kind="stable")
        down, toxic = x[order], y[order]
        # Cost of calling the first k toxic; at the threshold, a false alarm weighs as much as THRESHOLD / (1 - THRESHOLD) misses.
        cost = np.r_[0, np.cumsum(THRESHOLD * (1 - toxic) - (1 - THRESHOLD) * toxic)]
        cost[1:-1][down[1:] == down[:-1]] = np.inf  # no cut between equal ones
        k = int(np.argmin(cost))
        if 0 < k < len(down):
            b = np.log(THRESHOLD / (1 - THRESHOLD)) - a * (down[k - 1] + down[k]) / 2
    return np.array([a / spread, b - a * center / spread])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", toxic: int = FIT_TOXIC, clean: int = FIT_CLEAN, **settings) -> Model:
    """Train on at most so many labelled documents of each kind, those with the smallest hashes of their id.

    Rows without a label or an id are left out; of repeated labels the highest counts."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).alias("__label"))
    turn = [F.xxhash64("__id"), F.col("__id")]
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
    short = rows.where(F.octet_length("__text") <= FIT_TEXT_BYTES).select("__id").distinct()
    candidates = known.join(short, "__id")
    chosen = [candidates.where(F.col("__label") >= 1).orderBy(*turn).limit(toxic), candidates.where(F.col("__label") < 1).orderBy(*turn).limit(clean)]
    # Bounded by the two limits.
    chosen = chosen[0].unionByName(chosen[1])
    found = rows.join(F.broadcast(chosen), "__id").where(F.octet_length("__text") <= FIT_TEXT_BYTES).dropDuplicates(["__id"]).collect()
    found.sort(key=lambda r: (str(r["__id"]), r["__text"]))
    marks = np.array([int(r["__label"] >= 1) for r in found], np.int64)
    texts = [r["__text"].encode() for r in found]
    del found
    return train(texts, marks, **settings)


def _score(shared, keep: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        slope, shift = model["calibration"]
        for batch in batches:
            data, at = flat_bytes(batch.column(text))
            found = np.full(batch.num_rows, -np.inf)
            for a, b in pieces(at, _SCORE_PIECE):
                begin, end = int(at[a]), int(at[b])
                if end - begin <= 2 * _SCORE_PIECE:
                    found[a:b] = document_logits(model, tokens(data[begin:end], at[a : b + 1] - begin))
                    continue
                found[a] = long_text_logit(model, data[begin:end])
            score = 1 / (1 + np.exp(-np.clip(slope * found + shift, -50, 50)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(np.where(np.isfinite(found), score, 0.0))], [*keep, "score"])

    return run


def with_toxicity(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) plus ``score``, 0 to 1. Texts without a word (null, empty,
    no letters) score 0; repeated rows are scored each on its own; a column ``score`` in
    the input is replaced."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    rows, name, fields = with_own_text(docs, keep, text)
    return rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), keep, name), f"{fields}score double")
