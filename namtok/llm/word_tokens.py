"""Encoding by a public BPE vocabulary that lower-cases and drops white space, one word at a time.

White space never lies inside a pre-token of this vocabulary, so a text's tokens are those of its
words (the pieces between ASCII white space) in order. A word is looked up in three steps:

1. a two-generation cache of words seen before, of bounded size;
2. if its characters are all simple (see ``SIMPLE``), it is cut into pre-tokens here. A pre-token
   that the offline table proves to be one whole token costs one lookup, the rest is merged by the
   tokenizers library's model, without its normalisers, and kept in a second bounded cache;
3. any other word, and any with a special token's string, goes to the library as it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
from tokenizers import Tokenizer

#: Latin-1 characters but controls and white space: NFC leaves them alone and lower case maps each to one character.
SIMPLE = re.compile("[!-~¡-ÿ]+")
#: The vocabulary's split pattern, with its Unicode classes as they are within Latin-1.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
NUMBERS = "0-9²³¹¼-¾"
SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{LETTERS}{NUMBERS}]+")
#: Entries in one generation of a cache, and the longest key it keeps; a worker holds two generations of two caches at most.
CACHE, LONGEST_KEY = 400_000, 64


def byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use, by rule: printable Latin-1 bytes stand for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def whole_tokens(tokenizer: Tokenizer, suffix: str = "</w>") -> dict[str, int]:
    """Vocabulary strings that the library, asked about each alone, encodes as that one token."""
    letters, found = byte_letters(), {}
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        if token.endswith(suffix) and all(c in letters for c in token[: -len(suffix)]):
            try:
                found[bytes(letters[c] for c in token[: -len(suffix)]).decode()] = i
            except UnicodeDecodeError:
                continue
    texts = [t for t in found if t]
    encoded = tokenizer.encode_batch(texts, add_special_tokens=False)
    return {t: found[t] for t, e in zip(texts, encoded, strict=True) if e.ids == [found[t]]}


class Cache(dict):
    """A dict that computes what it lacks and keeps the last one to two times ``limit`` entries with keys of up to ``LONGEST_KEY``."""

    def __init__(self, compute, limit: int = CACHE):
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        if len(key) > LONGEST_KEY:
            return self.compute(key)
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class WordEncoder:
    """Ids of texts as arrays of little-endian unsigned integers."""

    def __init__(self, source: str, whole: dict[str, int]):
        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        pack = self.pack
        self.whole = {text: pack([i]) for text, i in whole.items()}
        merge, letters = self.tokenizer.model.tokenize, {b: c for c, b in byte_letters().items()}
        self.merged = Cache(lambda text: pack([t.id for t in merge(text.encode().decode("latin-1").translate(letters))]))
        self.words = Cache(self.word)

    def pack(self, ids: Iterable[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def word(self, raw: bytes) -> bytes:
        text = raw.decode("utf-8", "replace")
        if not SIMPLE.fullmatch(text) or any(s in raw for s in self.special):
            return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        whole, merged = self.whole, self.merged
        return b"".join([whole.get(p) or merged[p] for p in SPLIT.findall(text.lower())])

    def ids(self, text: bytes) -> bytes:
        """All ids of one whole text, packed."""
        return b"".join(map(self.words.__getitem__, text.split()))


_ENCODERS: dict[int, WordEncoder] = {}


def encoder(source: str, whole: dict[str, int]) -> WordEncoder:
    """This worker's encoder for a tokenizer, made once and kept from task to task."""
    key = hash(source)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(source, whole)
    return _ENCODERS[key]
