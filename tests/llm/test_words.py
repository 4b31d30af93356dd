import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from intervale.llm import bpe, pretoken, token_counts, word_codes

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
SPECIAL = {"<|endoftext|>": 50256}


def _texts():
    rng = random.Random(5)
    pool = [*"abst' \n\t19$.é  \x1c\x85lrevmd日՘٣", "'s", "'ll", "'re", " '", "<|endoftext|>", "\U0001e6c0", "é"]
    out = ["", *("".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(1500))]
    point = lambda: chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)]))
    return out + ["".join(point() + rng.choice(["", "'s", " ", " a", "1"]) for _ in range(200)) for _ in range(100)]


TEXTS = _texts()


@pytest.mark.parametrize("group", [1 << 18, 40, 7])
def test_texts_by_groups_and_parts_equal_the_library(group):
    """Any group size, with the table started anew every few hundred words."""
    want = [LIB.encode(x, add_special_tokens=False).ids for x in TEXTS]
    for encode in (word_codes.library_encode(LIB.model), bpe.merges(PATH).encode_words):
        assert [x.tolist() for x in word_codes.WordCodes(encode, SPECIAL, kept=500, group=group)(TEXTS)] == want


def test_starts_equal_the_pattern():
    for x in TEXTS:
        if x and "<|" not in x:
            start = np.flatnonzero(pretoken.word_starts(np.frombuffer(x.encode("utf-32-le"), "<u4"), np.array([0]))).tolist()
            assert [x[a:b] for a, b in zip(start, [*start[1:], len(x)], strict=True)] == pretoken.split(x)


def test_long_texts():
    """Texts of some MB, of words and of a single word's bytes; equal to the library's ids."""
    rng = random.Random(6)
    long = " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randrange(1, 9))) for _ in range(400_000))
    for text in (long, "7" * 300_000):
        assert next(iter(word_codes.library_words(PATH)([text]))).tolist() == LIB.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_raise():
    with pytest.raises(ValueError, match="byte-level"):
        word_codes.library_words(public_tokenizers.path("word_bpe_49k.json"))


def test_counts_by_sentencepiece(spark):
    """The .model path: whole texts, nulls empty."""
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = list(enumerate([None, "", "  a b ", "plain words, and ünïcode 日本", "x " * 700]))
    got = {r["doc_id"]: (r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    assert got == {i: (n := len(pieces.encode(t or "")), n > 512) for i, t in rows}
