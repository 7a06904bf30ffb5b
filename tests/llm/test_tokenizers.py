import base64
import random

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from ledgerloom.llm.bpe import PieceCodec, piece_model, read_ranks
from ledgerloom.llm.chunks import ChunkCache
from ledgerloom.llm.packing import WordEncoder

RANKS = P.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "B", "ab", "é", "日本", "'s", "'ll", "1", "23", " ", "  ", "\n", "\n\n", "\t", " ", " ", ".", ",", "!?", "_", "x", "the", "ª", "²", " ", "\xa0", "🙂"]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(0)
    made = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 25))) for _ in range(5000)]
    return [*made, "", " ", "\n", "a ", " a", "a  b", "word " * 5000, "x" * 20000]


@pytest.fixture(scope="module")
def expected(texts):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [encoding.encode_ordinary(x) for x in texts]


def _encode(cache, texts):
    out = []
    for lo in range(0, len(texts), 100):
        ids, bounds = cache.encode(texts[lo : lo + 100])
        out += [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
    return out


def test_piece_model_encodes_as_the_ranks_do(texts, expected):
    codec = PieceCodec(piece_model(read_ranks(RANKS)), P.PATTERN)
    assert _encode(codec.cache, texts) == expected
    assert [codec.decode(x) for x in expected] == [x.encode() for x in texts]


def test_word_encoder_equals_the_tokenizer(texts, expected):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    cache = ChunkCache(WordEncoder(P.path("byte_bpe_50k.json"), P.PATTERN, most=1000), most=1000)
    assert _encode(cache, texts) == expected
    special = "a <|endoftext|> b<|endoftext|>"
    assert _encode(cache, [special]) == [tokenizer.encode(special, add_special_tokens=False).ids]


def test_ranks_must_have_no_gaps():
    with pytest.raises(ValueError):
        piece_model({b"a": 0, b"b": 2})
