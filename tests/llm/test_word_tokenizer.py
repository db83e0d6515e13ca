"""Ids of the array-based word encoder against the library's own, over texts of odd characters."""

import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from manuscribe.llm import packing

ODD = ["É", "é", "ß", "À", "Þ", "×", "÷", "ÿ", "Ÿ", "µ", "ª", "²", "½", "«", "\xa0", "\x85", "\x1c", "\x7f", "́", "İ", "Σ", "你", "\U0001f600", "'", "'s", "'RE", "<", "<|endoftext|>", "_", "-", "...", "7", "42", "A", "z", "Th", "ing", " ", " ", "\n", "\t"]
FIXED = [None, "", " \n\t", "Don't stop -- it's 3.14%!", "<|startoftext|> a<|endoftext|>b", "Été ÉTÉ", "x" * 64, "x" * 65, "ab" * 3000, "ÀÉÎÕÜ×÷ß" * 8, "é" * 33, "1" * 70, "a b a b a"]


@pytest.fixture(scope="module")
def pair():
    path = packing.default_tokenizer()
    return packing.WordTokenizer(path), Tokenizer.from_file(path)


def ids(library, texts):
    return [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_plain_words_are_merged_as_arrays(pair):
    assert pair[0].pairs is not None


def test_ids_equal_the_library(pair):
    rng = random.Random(5)
    texts = FIXED + ["".join(rng.choice(ODD) for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    mine, library = pair
    assert [x.tolist() for x in mine.encode(pa.array(texts))] == ids(library, texts)


def test_end_and_a_full_memo(pair, monkeypatch):
    mine, library = pair
    monkeypatch.setattr(packing, "MEMO", 50)
    mine.clear()
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(30)]
    for t in texts:
        got = next(mine.encode(pa.array([t]), 1)).tolist()
        assert got == [*ids(library, [t])[0], 1]
