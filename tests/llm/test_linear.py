"""Inputs that once took time with the square of their length."""

import random
import time

import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers

from weftwork.llm import htmltext, transducer
from weftwork.llm.common import buffers
from weftwork.llm.vocabulary import Vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def counter():
    return transducer.TextCounter(Vocabulary.load(PATH))


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def counts(counter, texts):
    return counter.counts(*buffers(pa.array(texts, pa.string()))).tolist()


def test_special_strings_across_and_inside_texts(counter, library):
    rnd = random.Random(1)
    bits = ["<|endoftext|>", "<|", "endoftext", "|>", " ", "'s", "ab", "é"]
    texts = ["<|endoftext|>a<|endoftext|", "|>endoftext|>", "<|endoftext|><|endoftext|", "", "it's <|endoftext|>'ll"]
    texts += ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30))) for _ in range(400)]
    assert counts(counter, texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_long_words_equal_the_library(counter, library):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abcdefghijé") for _ in range(9000)), "a" * 9001, "ab" * 5000, "あ" * 3000]
    assert counts(counter, texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def growth(run, small, large):
    """Time of ``large`` by that of ``small``, the best of some runs."""

    def best(x):
        out = []
        for _ in range(3):
            began = time.perf_counter()
            run(x)
            out.append(time.perf_counter() - began)
        return min(out)

    return best(large) / max(best(small), 1e-3)


def test_many_special_strings(counter):
    special = lambda n: ["<|endoftext|>" * n]
    assert counts(counter, special(160_000)) == [160_000]
    assert growth(lambda t: counts(counter, t), special(10_000), special(80_000)) < 24


def test_unseen_words(counter):
    word = lambda n: ["".join(random.Random(n).choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))]
    assert growth(lambda t: counts(counter, t), word(20_000), word(160_000)) < 24


NESTED = {
    "items": lambda n: "<li><ul>" + "<b>" * n + "<li>" * n,
    "cells": lambda n: "<table><td><table>" + "<b>" * n + "<td>" * n,
    "ends": lambda n: "<x><td>" + "<b>" * n + "</x>" * n,
    "paragraphs": lambda n: "<p><div>" + "<b>" * n + "<p>x" * n,
}


@pytest.mark.parametrize("kind", NESTED)
def test_nested_tags(kind):
    assert growth(htmltext.visible_text, NESTED[kind](5_000), NESTED[kind](40_000)) < 24


def test_first_numbers_of_lists():
    assert htmltext.visible_text('<ol start="123456789012"><li>a<li>b</ol>') == "123456789012. a\n123456789013. b"
    assert htmltext.visible_text('<ol start="-3"><li>a</ol>') == "-3. a"
    assert htmltext.visible_text('<ol start="x1"><li>a</ol>') == "1. a"
