"""Exact tokenization by the tokenizers library with a cache of space-delimited chunks.

Both vocabularies here split text before a run of spaces and never join what spaces part, so the
ids of a text are the ids of its chunks, one after another.  Chunks repeat, and a table lookup is
many times faster than the library; each distinct chunk still goes through the library: a chunk of
plain Latin letters, digits and signs is split by the vocabulary's own pattern and its parts go to the
library's model, any other chunk goes through the whole of the library.  A text with white space
other than the space and the newline, or with the content of an added token (``<|endoftext|>``), goes
through the library whole.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

import numpy as np
import regex

#: Entries after which a worker starts its cache anew: about 100 MB.
MAX_CACHE = 700_000
#: Longer chunks are encoded but not kept.
MAX_CHUNK = 40
_MARKS = frozenset(".,!?;:")
_ODD_SPACE = re.compile(r"[^\S \n]")
_CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: Characters that no normalizer here changes but for lower case.
_PLAIN = re.compile(r"[\n -~\u00c0-\u012f\u0132-\u0148\u014a-\u017e]*")
# The pretokenizer patterns that the two vocabulary files name.
_WITH_SPACES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_NO_SPACES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_ENCODERS: dict[tuple[str, bool], Encoder] = {}


class _Words(dict):
    """Ids by chunk, where ``before`` stands before each that begins with no newline; chunks that are asked for first are encoded."""

    def __init__(self, encoder: Encoder, before: str):
        super().__init__()
        self.encoder, self.before = encoder, before
        self.letters = _LETTERS[32] if before else ""
        self.tokenize = encoder.model.tokenize

    def __missing__(self, word: str) -> bytes:
        if word[:1] == "\n" and self.before:  # a line's first word, after no space
            ids = self.encoder.part("\n") + self.encoder.cache[word[1:]]
        elif not word.isascii():
            ids = self.encoder.chunk(self.before + word)
        elif word.isalpha():  # one part
            ids = _bytes_of(self.tokenize(self.letters + (word if self.encoder.keeps_spaces else word.lower())))
        elif word[-1:] in _MARKS and word[:-1].isalpha():
            ids = self[word[:-1]] + self.encoder.part(word[-1])
        else:
            ids = self.encoder.chunk(self.before + word)
        if len(word) <= MAX_CHUNK:
            self[word] = ids
        return ids


def default_path(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()


def _bytes_of(tokens) -> bytes:
    """The ids of a model's tokens as little-endian uint16."""
    ids = array("H", [t.id for t in tokens])
    if sys.byteorder == "big":
        ids.byteswap()
    return ids.tobytes()


def _refuse_others(path: str, keeps_spaces: bool) -> None:
    """Raise for a vocabulary file whose steps are not those that the chunks and patterns here stand for."""
    with open(path, encoding="utf-8") as held:
        file = json.load(held)
    model = file.get("model", {})
    steps = json.dumps([file.get("pre_tokenizer"), file.get("normalizer")])
    lower = "Lowercase" in steps
    if model.get("type") != "BPE" or "ByteLevel" not in steps or lower == keeps_spaces:
        raise ValueError(f"no vocabulary that the chunks of {'leading' if keeps_spaces else 'no'} spaces are exact for: {path}")


class Encoder:
    """Texts to little-endian uint16 ids.  ``keeps_spaces``: are spaces part of the tokens that follow?"""

    def __init__(self, path: str, keeps_spaces: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        _refuse_others(path, keeps_spaces)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        # in any case of letters, which normalizers may change; a text too many in the library does no harm
        contents = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, contents)) or r"(?!)", re.IGNORECASE)
        self.keeps_spaces = keeps_spaces
        self.model = self.tokenizer.model
        self.pattern = _WITH_SPACES if keeps_spaces else _NO_SPACES
        self.cache = _Words(self, "")
        self.after_space = _Words(self, " ") if keeps_spaces else self.cache
        self.parts: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u2").tobytes() for e in found]

    def part(self, part: str) -> bytes:
        """Ids of a part, as the vocabulary's pattern gives it."""
        ids = self.parts.get(part)
        if ids is None:
            ids = self.parts[part] = _bytes_of(self.model.tokenize(part.encode().decode("latin-1").translate(_LETTERS)))
        return ids

    def chunk(self, chunk: str) -> bytes:
        """Ids of any chunk, spaces before it among it."""
        if not _PLAIN.fullmatch(chunk):
            return self._library([chunk])[0]
        return b"".join(map(self.part, self.pattern.findall(chunk if self.keeps_spaces else chunk.lower())))

    def _ids(self, text: str) -> bytes:
        if not self.keeps_spaces:
            return b"".join(map(self.cache.__getitem__, text.replace("\n", " ").split(" ")))
        if "  " in text or "\n " in text or " \n" in text or "\n\n" in text:
            return b"".join(map(self.cache.__getitem__, _CHUNK.findall(text)))
        first, *rest = text.replace("\n", " \n").split(" ")  # a single newline is a part of its own
        return self.cache[first] + b"".join(map(self.after_space.__getitem__, rest))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint16 bytes."""
        for held in (self.cache, self.after_space, self.parts):
            if len(held) > MAX_CACHE:
                held.clear()
        whole = [bool(_ODD_SPACE.search(t) or self.added.search(t)) for t in texts]
        library = iter(self._library([t for t, w in zip(texts, whole, strict=True) if w]))
        return [next(library) if w else self._ids(t) for t, w in zip(texts, whole, strict=True)]


def encoder(path: str, keeps_spaces: bool) -> Encoder:
    """The worker's encoder for a vocabulary file; workers are reused, and so is the cache."""
    key = (path, keeps_spaces)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, keeps_spaces)
    return _ENCODERS[key]


def forget() -> None:
    """Drop the worker's encoders and their caches."""
    _ENCODERS.clear()
