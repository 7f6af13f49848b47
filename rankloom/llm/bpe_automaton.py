"""Byte-pair encoding by a deterministic automaton over tokens.

The automaton reads tokens and accepts exactly the token sequences that the merges give.
It begins with one state that every byte leads back to. Each merge (u, v) -> w, in order,
is one gadget: the state that u leads to is split, u now leads to a copy of it without
the arc v, and beside every arc u a new arc w leads to where v led from the old state.
So an arc's target depends on its token alone, and a state is its parent less one arc.

States are kept as that tree. The states without an arc form one range of the tree's
order per cut, so an arc is looked up in a sorted table of ranges, one entry per merge,
whatever the number of arcs (which is the states times the tokens). The arc w exists
where the arc u existed when w was made, which leads the lookup down to a byte.

Every prefix of a word has one accepted sequence, so each position of a word has one
state, and a search with a trie of the tokens visits it once.
Words are what the published pattern cuts a text into; decoding puts out arc labels.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from rankloom.llm.shared import small_batches, with_own_text

# --- Fixed values: they have to equal the published ones ---------------------
#: What a text is cut into before merging.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes that stand for themselves in a vocabulary file; the others follow from 256 on.
VISIBLE_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
# ------------------------------------------------------------------------------

#: Words and arcs a worker remembers before it starts anew, and the longest such word.
HELD_WORDS = 400_000
HELD_ARCS = 200_000
HELD_LENGTH = 48
#: Words of a text that are worked on at a time.
WORDS_AT_ONCE = 100_000

_NEVER = 1 << 62


def byte_letters() -> dict[str, int]:
    """The letter of a vocabulary file for each byte."""
    hidden = [b for b in range(256) if b not in set(VISIBLE_BYTES)]
    return {**{chr(b): b for b in VISIBLE_BYTES}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


class _Words(dict):
    """Ids of words as bytes; a word not met before is encoded."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(word.encode("utf-8", "surrogatepass")), "<u4").tobytes()
        if len(word) <= HELD_LENGTH:
            if len(self) >= HELD_WORDS:
                self.clear()
            self[word] = ids
        return ids


@dataclass
class TokenAutomaton:
    """Tables of a compiled vocabulary; the derived ones are built where they are first used."""

    labels: list[bytes | None]  # by token id; None where there is no token
    specials: dict[str, int]
    left: np.ndarray  # by token id: the token beside whose arcs this one's were added, -1 for a byte
    birth: np.ndarray  # by token id: the merge that made it, 0 for a byte, -1 without arcs
    target: np.ndarray  # by token id: place of its target state in the tree's order
    cut_at: np.ndarray  # by token id: where its ranges begin in the next three
    cut_first: np.ndarray
    cut_end: np.ndarray
    cut_time: np.ndarray
    stand_ins: dict[int, str] = field(default_factory=dict)

    def __getstate__(self):
        return {name: self.__dict__[name] for name in self.__dataclass_fields__}

    @cached_property
    def _lookup(self):
        return tuple(a.tolist() for a in (self.left, self.birth, self.cut_at, self.cut_first, self.cut_end, self.cut_time))

    def has_arc(self, state: int, token: int) -> bool:
        """Whether the token can follow in the state (given by its place)."""
        left, birth, cut_at, first, end, time = self._lookup
        made = _NEVER
        while True:
            if birth[token] < 0:
                return False
            i = bisect_right(first, state, cut_at[token], cut_at[token + 1]) - 1
            if i >= cut_at[token] and state < end[i] and time[i] <= made:
                return False
            if left[token] < 0:
                return True
            token, made = left[token], birth[token]

    @cached_property
    def _trie(self) -> tuple[dict[int, int], list[int]]:
        """Nodes by (parent node, byte), and the token that ends in a node, -1 for none."""
        step, ends = {}, [-1]
        for token, label in enumerate(self.labels):
            if label is None or self.birth[token] < 0:
                continue
            node = 0
            for b in label:
                key = node << 8 | b
                node = step.get(key)
                if node is None:
                    node = step[key] = len(ends)
                    ends.append(-1)
            ends[node] = token
        return step, ends

    @cached_property
    def _arcs(self) -> dict[int, bool]:
        return {}

    @cached_property
    def _targets(self) -> list[int]:
        return self.target.tolist()

    def encode_word(self, word: bytes) -> list[int]:
        """The one accepted sequence of tokens that spells the word.

        The longest token that has an arc is tried first. A position that leads nowhere is
        not tried again: whatever led to it, it has the same state.
        """
        step, ends = self._trie
        arcs, targets, n = self._arcs, self._targets, len(word)
        if len(arcs) > HELD_ARCS:
            arcs.clear()
        found, at, i, state, stuck = [], [], 0, 0, set()
        choices = None  # tokens that may come at i with their ends, the longest last
        while i < n:
            if choices is None:
                node, choices = 0, []
                for j in range(i, n):
                    node = step.get(node << 8 | word[j])
                    if node is None:
                        break
                    if ends[node] >= 0:
                        choices.append((ends[node], j + 1))
            while choices:
                token, end = choices.pop()
                if end in stuck:
                    continue
                key = state << 20 | token
                known = arcs.get(key)
                if known is None:
                    known = arcs[key] = self.has_arc(state, token)
                if known:
                    found.append(token)
                    at.append((i, state, choices))
                    i, state, choices = end, targets[token], None
                    break
            else:
                stuck.add(i)
                found.pop()
                i, state, choices = at.pop()
        return found

    @cached_property
    def _words(self) -> _Words:
        return _Words(self.encode_word)

    @cached_property
    def _pattern(self):
        return regex.compile(WORD_PATTERN)

    @cached_property
    def _special_pattern(self):
        longest_first = sorted(self.specials, key=len, reverse=True)
        return re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None

    def split_words(self, text: str) -> Iterator[list[str]]:
        """The words of a text, some at a time."""
        own = text
        if self.stand_ins and not text.isascii() and not self.stand_ins.keys().isdisjoint(map(ord, text)):
            own = text.translate(self.stand_ins)
        if own is text and len(text) < WORDS_AT_ONCE:
            yield self._pattern.findall(text)
            return
        found = self._pattern.finditer(own)
        while some := [text[m.start() : m.end()] for m in islice(found, WORDS_AT_ONCE)]:
            yield some

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        parts = self._special_pattern.split(text) if self.specials else [text]
        ids = []
        for i, part in enumerate(parts):
            if i % 2:
                ids.append(np.array([self.specials[part]], "<u4").tobytes())
            elif part:
                ids += [b"".join(map(self._words.__getitem__, some)) for some in self.split_words(part)]
        return b"".join(ids)

    def decode(self, ids: bytes) -> str:
        """The labels of the ids, one after the other; ids that are no tokens are left out."""
        numbers, labels = np.frombuffer(ids, "<u4"), self.labels
        if len(numbers) and int(numbers.max()) >= len(labels):
            numbers = numbers[numbers < len(labels)]
        return b"".join([labels[i] or b"" for i in numbers.tolist()]).decode("utf-8", "replace")


def compile_merges(labels: list[bytes | None], merges: list[tuple[int, int, int]], specials: dict[str, int]) -> TokenAutomaton:
    """The automaton of the merges (left, right, merged token) in their order.

    A merge has to put together tokens that are bytes or made by earlier merges, and to
    make a token of its own; other lists are refused, since there the order of the merges
    does not settle the result.
    """
    if len(labels) >= 1 << 20:
        raise ValueError("more than 2^20 tokens")
    n = len(labels)
    left, birth, target = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.zeros(n, np.int64)
    taken = set(specials.values())
    for token, label in enumerate(labels):
        if label is not None and len(label) == 1 and token not in taken:
            birth[token] = 0
    # State s > 0 is made by merge s: a copy of its parent without one arc.
    parent, cut = np.zeros(len(merges) + 1, np.int64), np.full(len(merges) + 1, -1, np.int64)
    for time, (u, v, w) in enumerate(merges, 1):
        if min(birth[u], birth[v]) < 0 or birth[w] >= 0:
            raise ValueError(f"merge {time} is not of earlier tokens, or its token is there already")
        target[w], birth[w], left[w] = target[v], time, u
        parent[time], cut[time] = target[u], v
        target[u] = time
    size = np.ones(len(parent), np.int64)
    for s in range(len(parent) - 1, 0, -1):
        size[parent[s]] += size[s]
    place, free = np.zeros(len(parent), np.int64), np.ones(len(parent), np.int64)
    for s in range(1, len(parent)):
        p = parent[s]
        place[s] = place[p] + free[p]
        free[p] += size[s]
    states = np.arange(1, len(parent))
    order = states[np.lexsort((place[1:], cut[1:]))]
    # A range within another of the same token says nothing new (its merge never applies).
    outer, end = [], 0
    for i, s in enumerate(order.tolist()):
        if not i or cut[s] != cut[order[i - 1]] or place[s] >= end:
            outer.append(s)
            end = place[s] + size[s]
    order = np.array(outer, np.int64)
    built = TokenAutomaton(
        labels, specials, left, birth, place[target],
        np.searchsorted(cut[order], np.arange(n + 1)), place[order], place[order] + size[order], order,
    )
    # A merge whose right token cannot follow the left one any more makes no arcs.
    dead = []
    for time, (_, v, w) in enumerate(merges, 1):
        if not built.has_arc(int(place[parent[time]]), v):
            dead.append(w)
            built._lookup[1][w] = -1
    built.birth[dead] = -1
    built.__dict__.pop("_lookup")
    return built


def _classes(split) -> dict[int, str]:
    """Code points that the vocabulary's own library takes for another kind of character than the
    pattern here does (by Unicode version), each with a character of its kind."""
    assigned = regex.compile(r"\P{Cn}")
    points = [c for c in map(chr, range(128, 0x110000)) if not 0xD800 <= ord(c) < 0xE000 and assigned.match(c)]
    differ = {}
    for sign, like, pattern in (("a", "z", r"\p{L}"), ("1", "0", r"\p{N}")):
        whole = {start for start, end in split("\n".join(sign + c + sign for c in points)) if end - start == 3}
        ours, rest = regex.compile(pattern).match, []
        for i, c in enumerate(points):
            if 4 * i in whole:
                if not ours(c):
                    differ[ord(c)] = like
                else:
                    differ.pop(ord(c), None)
                continue
            rest.append(c)
            if ours(c):
                differ[ord(c)] = "\u0378"  # neither letter, number nor space
        points = rest
    return differ


@lru_cache(2)
def load_vocabulary(path: str) -> TokenAutomaton:
    """Compile a vocabulary file of byte-level merges.

    Only what such a file has without options is supported: no normalizer, no prefix
    space, plain special tokens. Anything else is refused.
    """
    with open(path, encoding="utf-8") as f:
        stored = json.load(f)
    model, split = stored["model"], stored["pre_tokenizer"]
    options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")
    if (
        model["type"] != "BPE" or any(model.get(o) for o in options) or stored["normalizer"]
        or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split.get("use_regex", True)
        or any(t[o] for t in stored["added_tokens"] for o in ("single_word", "lstrip", "rstrip", "normalized"))
    ):
        raise ValueError(f"{path} is not a plain byte-level vocabulary")
    letters, vocabulary = byte_letters(), model["vocab"]
    specials = {t["content"]: t["id"] for t in stored["added_tokens"]}
    labels: list[bytes | None] = [None] * (1 + max([*vocabulary.values(), *specials.values()]))
    for token, i in vocabulary.items():
        labels[i] = bytes(letters[c] for c in token)
    for token, i in specials.items():
        labels[i] = token.encode()
    if {bytes([b]) for b in range(256)} - set(labels):
        raise ValueError(f"{path} lacks tokens of single bytes")
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    merges = [(vocabulary[u], vocabulary[v], vocabulary[u + v]) for u, v in pairs]
    built = compile_merges(labels, merges, specials)

    from tokenizers import pre_tokenizers

    own = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    built.stand_ins = _classes(lambda text: [at for _, at in own.pre_tokenize_str(text)])
    return built


def _encode(shared, keep: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            ids = [automaton.encode(t) if t else b"" for t in (v.as_py() for v in batch.column(text))]
            counts = pa.array([len(i) // 4 for i in ids], pa.int64())
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, counts, pa.array(ids, pa.binary())], [*keep, "n_tokens", "token_ids"])

    return run


def with_token_ids(docs: DataFrame, automaton: TokenAutomaton, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all, unless named), ``n_tokens`` and ``token_ids``: the ids of the whole
    text as little-endian unsigned 32-bit integers.

    A null text counts as empty and has no ids. Texts of any length are cut into words some
    at a time. Special tokens written out in a text are found, as the vocabulary's library
    does. Repeated rows give repeated rows, an empty table none. Kept columns must not be
    called ``n_tokens`` or ``token_ids``: they are left out of the default, and refused by name.
    """
    new = ("n_tokens", "token_ids")
    if keep and set(keep) & set(new):
        raise ValueError("n_tokens and token_ids are the new columns")
    keep = [c for c in docs.columns if c not in new] if keep is None else keep
    rows, own, fields = with_own_text(docs, keep, text)
    shared = docs.sparkSession.sparkContext.broadcast(automaton)
    return rows.mapInArrow(_encode(shared, keep, own), fields + "n_tokens long, token_ids binary")


def _decode(shared, keep: list[str], ids: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            texts = [automaton.decode(v.as_py() or b"") for v in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, out])

    return run


def with_decoded_text(rows: DataFrame, automaton: TokenAutomaton, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """All columns and ``out``, the text that the ids stand for; null ids give the empty text.

    Bytes that are no UTF-8 become replacement characters, as in the vocabulary's library. A
    column called as ``out`` is replaced.
    """
    small_batches(rows.sparkSession)
    keep = [c for c in rows.columns if c != out]
    read = keep if ids in keep else [*keep, ids]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*[f"`{c}`" for c in keep]).schema)
    shared = rows.sparkSession.sparkContext.broadcast(automaton)
    return rows.select(*[f"`{c}`" for c in read]).mapInArrow(_decode(shared, keep, ids, out), f"{fields}`{out}` string")
