"""The merge automaton against the tokenizers library, on all documents, awkward texts and random small vocabularies."""

import hashlib
import itertools
import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import automaton
from ledgerloom.llm.queries import op11_merge_automaton

PATH = P.path("word_bpe_49k.json")
PARTS = [
    "a", "B", "ab", "é", "é", "日本", "'s", "'LL", "'Re", "1", "23", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", " ", "\xa0", ".", ",", "!?", "_", "x", "the", "THE", "ª", "²",
    "İ", "Σ", "ΣΑΣ", "ß", "🙂", "\0", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "ﬁ", "́", "̧", "각", "ᄀ", "ᅡ", "‍", "﻿", "tokenization", "</w>",
]


@pytest.fixture(scope="module")
def codec():
    return automaton.WordCodec(PATH, most=2000)


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def test_encodes_and_decodes_as_the_library_does(codec, library):
    r = random.Random(0)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 25))) for _ in range(6000)]
    texts += ["".join(chr(r.choice([r.randint(1, 0x2FF), r.randint(0x300, 0xD7FF), r.randint(0xE000, 0x1FFFF)])) for _ in range(20)) for _ in range(3000)]
    texts += ["", " ", "word " * 5000, "x" * 20000, "ab" * 9000, "lo" * 500 + " " + "1" * 3000]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids = np.frombuffer(codec.encode(text), "<u4").tolist()
        assert ids == want.ids, text[:100]
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def greedy(word, ranks):
    """BPE by the book: the leftmost pair of lowest rank is merged until there is none."""
    while len(word) > 1:
        rank, at = min((ranks.get(pair, len(ranks)), i) for i, pair in enumerate(zip(word, word[1:])))
        if rank == len(ranks):
            break
        word = [*word[:at], word[at] + word[at + 1], *word[at + 2 :]]
    return word


def test_paths_are_exactly_what_greedy_merging_leaves():
    r = random.Random(1)
    for _ in range(60):
        tokens, merges = ["a", "b", "c"], []
        while len(merges) < 12:
            u, v = r.choice(tokens), r.choice(tokens)
            if u + v not in tokens:
                merges.append((u, v))
                tokens.append(u + v)
        vocab = {t: i for i, t in enumerate(tokens)}
        machine = automaton.MergeAutomaton(vocab, merges, "")
        ranks = {m: i for i, m in enumerate(merges)}
        for n in range(1, 8):
            for letters in itertools.product("abc", repeat=n):
                word, want = "".join(letters), [vocab[t] for t in greedy(list(letters), ranks)]
                state, at = [0] + [-1] * n, {}
                for j in range(n):  # all paths that spell the word, by the tables alone
                    for t in tokens if state[j] >= 0 else ():
                        if word.startswith(t, j) and (to := machine.step(state[j], vocab[t])) >= 0:
                            assert state[j + len(t)] < 0, "a prefix has two paths"
                            state[j + len(t)], at[j + len(t)] = to, (j, vocab[t])
                found, i = [], n
                while i:
                    i, t = at[i]
                    found.append(t)
                assert found[::-1] == want, (word, merges)


def test_vocabularies_that_no_automaton_of_this_kind_fits():
    with pytest.raises(ValueError):
        automaton.MergeAutomaton({"a": 0, "b": 1, "ab": 2, "aba": 3, "ba": 4}, [("ab", "a"), ("a", "b"), ("b", "a")], "")
    with pytest.raises(ValueError):
        automaton.MergeAutomaton({"a": 0, "aa": 1, "aaa": 2}, [("a", "a"), ("a", "aa"), ("aa", "a")], "")


def test_registered_query_on_every_document(spark, sf, library):
    rows = {r.doc_id: r for r in op11_merge_automaton(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for (doc_id, _), e in zip(docs, library.encode_batch([d.text or "" for d in docs], add_special_tokens=False)):
        r = rows[doc_id]
        assert r.n_tokens == len(e.ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(e.ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()


def test_awkward_rows(spark, library):
    data = [(1, None, 5), (2, "", 5), (None, "one two", 5), (3, "same", 5), (3, "same", 5), (4, "y" * 100_000, 5), (5, " \n ", 5)]
    df = spark.createDataFrame(data, "doc_id int, text string, ids int").withColumnRenamed("ids", "decoded")
    out = sorted(((r.doc_id or 0, r.n_tokens, bytes(r.ids), r.decoded) for r in automaton.encode_words(df, PATH).collect()), key=str)
    want = []
    for i, text, _ in data:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i or 0, len(ids), np.array(ids, dtype="<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert out == sorted(want, key=str)
    assert automaton.encode_words(df.limit(0), PATH).count() == 0
