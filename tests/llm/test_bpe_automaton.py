import hashlib
import itertools
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, pre_tokenizers

from conftest import SMALL
from rankloom.llm.bpe_automaton import WORD_PATTERN, compile_merges, load_vocabulary, with_decoded_text, with_token_ids
from rankloom.llm.queries import op12_bpe_automaton
from rankloom.llm.shared import table

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def automaton():
    return load_vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def small(merges):
    """An automaton over the letters a, b, c and the given merges, and its labels."""
    labels = [b"a", b"b", b"c"] + [u + v for u, v in merges]
    return compile_merges(labels, [(labels.index(u), labels.index(v), labels.index(u + v)) for u, v in merges], {})


def merged(word, merges):
    """Merging by the definition: the earliest merge that applies, leftmost first."""
    parts = [bytes([b]) for b in word]
    while True:
        found = [(merges.index((u, v)), i) for i, (u, v) in enumerate(zip(parts, parts[1:])) if (u, v) in merges]
        if not found:
            return parts
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def drawn_merges(seed):
    draw, parts, merges = random.Random(seed), [b"a", b"b", b"c"], []
    for _ in range(9):
        u, v = draw.choice(parts), draw.choice(parts)
        if u + v not in parts and len(u + v) <= 6:
            merges.append((u, v))
            parts.append(u + v)
    return merges


@pytest.mark.parametrize("seed", range(40))
def test_all_short_words_of_drawn_merges(seed):
    merges = drawn_merges(seed)
    built = small(merges)
    for n in range(1, 8):
        for letters in itertools.product(b"abc"[: 3 if n < 6 else 2], repeat=n):
            word = bytes(letters)
            assert [built.labels[t] for t in built.encode_word(word)] == merged(word, merges), (merges, word)


@pytest.mark.parametrize("seed", range(8))
def test_accepts_one_sequence_for_each_word(seed):
    merges = drawn_merges(seed)
    built = small(merges)

    def accepted(word, state=0):
        if not word:
            return 1
        tokens = [t for t, label in enumerate(built.labels) if word.startswith(label) and built.has_arc(state, t)]
        return sum(accepted(word[len(built.labels[t]) :], int(built.target[t])) for t in tokens)

    for letters in itertools.product(b"ab", repeat=7):
        assert accepted(bytes(letters)) == 1


def test_merges_that_do_not_settle_the_result_are_refused():
    with pytest.raises(ValueError):
        compile_merges([b"a", b"b", b"ab", b"aba"], [(2, 0, 3), (0, 1, 2)], {})
    with pytest.raises(ValueError):
        compile_merges([b"a", b"aa", b"aaa"], [(0, 0, 1), (0, 1, 2), (1, 0, 2)], {})


TEXTS = [
    "", " ", "a", "they're we'LL I'd 'tis", "  two  spaces \n\n tabs\t\tend  ", "ÀÉ naïve ﬁ ½ ² Ⅷ 12345 x9y", "日本語 テキスト 한국어",
    "🤗🤷🏽‍♀️ emoji", "<|endoftext|>", "a<|endoftext|><|endoftext|> b<|endoftext", "\x00\x1f\x7f\x85\xa0 　|", "﻿�",
    "a" * 10_001, "ab" * 3_000, " " * 5_000, "-" * 3_000 + "=" * 3_000, "the" * 2_000, "՘ a࢏b 1\U00011de1 2", "é ͸ \U0010ffff",
]


def test_equals_the_library(automaton, library):
    draw = random.Random(5)
    more = ["".join(draw.choices("ab the'sÉ1 \n.日", k=draw.randint(1, 60))) for _ in range(2_000)]
    for text, theirs in zip(TEXTS + more, library.encode_batch(TEXTS + more, add_special_tokens=False)):
        ids = automaton.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == theirs.ids, text[:80]
        assert automaton.decode(ids) == text == library.decode(theirs.ids, skip_special_tokens=False)


def test_every_character_is_split_as_by_the_library(automaton):
    assert WORD_PATTERN == public_tokenizers.PATTERN
    own = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for first in range(0, len(points), 5_000):
        text = "".join(f"a{c}a 1{c}1 !{c}! {c}{c}|" for c in points[first : first + 5_000])
        assert [text[s:e] for _, (s, e) in own.pre_tokenize_str(text)] == [w for some in automaton.split_words(text) for w in some]


def test_tables_survive_the_way_to_a_worker(automaton):
    import pickle

    copy = pickle.loads(pickle.dumps(automaton))
    assert copy.encode("Some text, twice. Some text") == automaton.encode("Some text, twice. Some text")


def test_decoding_ids_that_stand_for_no_text(automaton, library):
    for ids in ([0, 50_300, 1], [220, 0xE9, 128], [4_000_000_000], list(range(0, 50_257, 7))):
        known = [i for i in ids if i < 50_257]
        assert automaton.decode(np.array(ids, "<u4").tobytes()) == library.decode(known, skip_special_tokens=False)


def test_odd_rows(spark, automaton, library):
    rows = [(1, None, "x"), (None, "a b", None), (1, "a b", "x"), (1, "a b", "x"), (2, "", "y"), (3, "<|endoftext|>", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    found = with_token_ids(docs, automaton)
    assert found.columns == ["doc_id", "text", "n_tokens", "token_ids"]
    for r in with_decoded_text(found, automaton).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.decoded) == (len(ids), r.text or "") and np.frombuffer(r.token_ids, "<u4").tolist() == ids
    assert found.count() == 6
    assert with_decoded_text(with_token_ids(docs.limit(0), automaton), automaton).collect() == []
    # Ids by another name, a null, and a column of the new name.
    ids = spark.createDataFrame([(b"\x00\x00\x00\x00", "old"), (None, "old")], "ids binary, decoded string")
    assert [r.decoded for r in with_decoded_text(ids, automaton, "ids").collect()] == ["!", ""]


def test_query_equals_the_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in table(spark, SMALL, "documents").collect()}
    found = op12_bpe_automaton(spark, SMALL).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = np.array(library.encode(texts[r.doc_id], add_special_tokens=False).ids, "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
