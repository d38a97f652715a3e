"""Encoding of whole texts with a tokenizer file, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from tokenizers import Tokenizer

#: Separators of str.split() that the tokenizer's pattern takes for symbols.
_ODD = re.compile("[\x1c-\x1f]")
#: Letters of Latin-1 with any ASCII punctuation behind, which the tokenizer cuts into one word and one run of symbols.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
#: Symbols right before a comma or full stop belong to one run with it.
_RUN = re.compile(r"[,.](?<=[^\w\s].|_.)[ \n]")
#: Encoded chunks that a worker keeps.
CACHE = 400_000


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for the letters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class _Chunks(dict):
    """Ids, as little-endian 32-bit numbers, of stretches of text between white space."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer, self.model, self.tails, self.words = tokenizer, tokenizer.model, {"": b""}, {}
        letters = _byte_letters()
        self.spelt = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0xDF, 0x100)}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        if plain := _PLAIN.fullmatch(chunk):
            word, tail = plain.groups()
            if tail not in self.tails:
                if len(self.tails) >= CACHE:
                    self.tails = {"": b""}
                self.tails[tail] = self.whole(tail)
            word = word.lower()
            found = self.words.get(word)
            if found is None:
                if len(self.words) >= CACHE:
                    self.words.clear()
                spelt = word if word.isascii() else word.translate(self.spelt)
                found = self.words[word] = np.array([t.id for t in self.model.tokenize(spelt)], "<u4").tobytes()
            if tail:
                found += self.tails[tail]
        else:
            found = self.whole(chunk)
        self[chunk] = found
        return found


def _latin(text: str) -> bool:
    """Whether all letters are of Latin-1, where lower-casing and normalisation go letter by letter."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def encoder(tokenizer_json: str, by_chunk: bool) -> Callable[[str], bytes]:
    """A function from a text to its ids, as little-endian 32-bit numbers.

    ``by_chunk`` is right for tokenizers that drop white space, lower-case letter by letter and never join across white
    space, as the word-level BPE does: chunks are then encoded once and kept.
    """
    tokenizer = Tokenizer.from_str(tokenizer_json)
    chunks = _Chunks(tokenizer)
    if not by_chunk:
        return chunks.whole

    def encode(text: str) -> bytes:
        if _ODD.search(text):
            return chunks.whole(text)
        if _latin(text) and "<|" not in text:  # special tokens are written in lower case
            text = text.lower()
            if not _RUN.search(text):  # a comma or full stop behind a word is a token of its own
                text = text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " .\n")
        return b"".join(map(chunks.__getitem__, text.split()))

    return encode
