"""Ids of texts that hold added tokens, against the library as it is loaded."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm.tokens import Encoder, default_path

KINDS = {name: (Tokenizer.from_file(default_path(name)), Encoder(default_path(name), spaces)) for name, spaces in [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]}
PARTS = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "endoftext", " ", "  ", "\n", "\t", "end", "Start", "é", "1", "."]


def _same(texts):
    for library, own in KINDS.values():
        for text, ids in zip(texts, own.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name, want", [("byte_bpe_50k.json", [437, 220, 50256, 923]), ("word_bpe_49k.json", [806, 49407, 1572])])
def test_added_token_has_its_own_id(name, want):
    assert np.frombuffer(KINDS[name][1].encode(["end <|endoftext|> start"])[0], "<u2").tolist() == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=8).map("".join), max_size=4))
def test_texts_with_added_tokens_are_the_librarys(texts):
    _same(texts)


def test_words_beside_newlines_are_cached_as_words():
    texts = ["one two\nthree four.\nÜber's\n", "\ntwo\none four\nthree 12", "a\n\nb \n c\n\n\nd"]
    _same(texts)
    own = Encoder(default_path("byte_bpe_50k.json"), True)
    own.encode(texts[:2])
    assert not any("\n" in chunk[1:] for chunk in own.cache)
