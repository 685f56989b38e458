"""Token ids of many texts by a ``tokenizers`` file, encoding each distinct
word once.

A pre-tokenizer never joins what lies on both sides of a word gap, so a text's
ids are its words' ids in a row.  Words are looked up in a bounded cache of two
generations (a full one becomes the old one, words met again move on) and only
new ones go to the library, many in one text, whose ids are cut at the words'
places; those that differ by letters' case or a mark at their end only go once
if the tokenizer folds cases.  A text whose gaps are unusual (see ``_byte_words`` and
``_plain_words``) or that may hold a special token's string goes to the library
whole.
"""

from __future__ import annotations

import gc
import os
import re

import numpy as np

CACHE_WORDS = 450_000    # of one generation
ROW_WORDS = 4096         # new words of one text for the library
SPLIT_CHARS = 1 << 20    # characters of texts cut into words at once
PLAIN_LETTERS = "\u024f"    # letters up to here have one lower-case form and are composed; but for U+0130
MARKS = ".,;:!?"         # that the white-space pattern parts from a letter or digit before them

# A space that no word follows: the byte-level pattern then joins gaps.
_ODD_SPACE = re.compile(r" (?:\s|\Z)")
# White space beyond ASCII, where libraries differ.
_ODD_BLANK = re.compile(r"[\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000-\u200f\u2028\u2029\u202f\u205f\u3000\ufeff]")


_ASCII_BLANKS = "\t\n\v\f\r\x1c\x1d\x1e\x1f"
_LINE_FEED = ("\n",)


def _odd_space(text: str) -> bool:
    """Whether ``_ODD_SPACE`` is found, mostly told by plain searches."""
    if "  " in text or text.endswith(" "):
        return True
    if text.isascii():
        return any(c in text and " " + c in text for c in _ASCII_BLANKS)
    return _ODD_SPACE.search(text) is not None


def _odd_line(lines: list[str]) -> bool:
    """Whether a line feed between ``lines`` has more white space, or an end
    of the text, beside it: the byte-level pattern then joins them."""
    return not all(lines) or any(x[-1].isspace() for x in lines[:-1]) or any(x[0].isspace() for x in lines[1:])


def _byte_words(text: str) -> list[str] | None:
    """Words of a byte-level text, each with its leading space."""
    if _odd_space(text):
        return None
    first, *rest = text.split(" ")
    return [first, *[" " + w for w in rest]] if first else [" " + w for w in rest]


def _byte_keys(text: str) -> list | None:
    """Words of a byte-level text: as strings those after a blank, without
    it; as tuples all others, line feeds and the words right after them."""
    if _odd_space(text):
        return None
    out: list = []
    lines = text.split("\n")
    for line in [text] if _odd_line(lines) else lines:
        words: list = line.split(" ")
        words[0] = (words[0],)
        if out:
            out.append(_LINE_FEED)
        out += words
    if out[0] == ("",):
        del out[0]
    return out


def _plain_words(text: str) -> list[str] | None:
    """Words of a text whose tokenizer drops white space."""
    return None if _ODD_BLANK.search(text) else text.split()


class WordEncoder:
    """``encode(texts)`` gives each text's ids as little-endian uint32 bytes,
    equal to the library's ``encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.byte_level = self.tokenizer.normalizer is None
        self.words = _byte_keys if self.byte_level else _plain_words
        self.cache: dict = {}
        self.old: dict = {}
        # Bytes of a token: as many as its letters, without the sign of a word's end.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None) or ""
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.n_bytes[list(vocabulary.values())] = [len(t.removesuffix(suffix)) for t in vocabulary]
        self.folds = not self.byte_level and self.tokenizer.normalizer.normalize_str("A\u00c9") == "a\u00e9" and not any(s.isalnum() for s in self.special)
        self.marks = dict(zip(["", *MARKS], self._library(["", *MARKS])))

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joins(self, core: str) -> bool:
        """Whether a word can stand among others in one text."""
        return core.isprintable() and (self.byte_level or core.isascii() or max(core) <= PLAIN_LETTERS and "\u0130" not in core)

    def _parts(self, word: str) -> tuple[str, str]:
        """``word`` as a lower-case run of letters and digits and the mark
        after it: they have no token in common.  Other words stay as they are."""
        mark = word[-1] if word[-1] in MARKS else ""
        form = word[:-1] if mark else word
        return (form.lower(), mark) if form.isalnum() else (word, "")

    def _row(self, words: list[str], blank: str, first: str) -> list[bytes] | None:
        """Ids of each of ``words``, from one text of them all: what a blank
        parts has no token in common.  Nothing if that text holds a special
        token's string, or if its tokens have other bytes than its words."""
        text = first + blank.join(words)
        if any(s in text for s in self.special):
            return None
        ids = np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        at = np.concatenate([[0], np.cumsum(self.n_bytes[ids])])
        if self.byte_level:
            # A space is its word's first byte; a line feed is a token of its own.
            size = np.asarray([len(w) if w.isascii() else len(w.encode()) for w in words], np.int64) + 1
            end = np.cumsum(size) - (not first)
            begin = end - size + (not first)
        else:
            # The blanks are dropped.
            size = np.asarray([len(w) if w.isascii() else len(w.lower().encode()) for w in words], np.int64)
            end = np.cumsum(size)
            begin = end - size
            if at[-1] != end[-1]:
                return None
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip((4 * np.searchsorted(at, begin)).tolist(), (4 * np.searchsorted(at, end)).tolist())]

    def _learn(self, keys: set) -> None:
        """Puts the words that are not cached into the cache."""
        blank, alone, odd = [], [], []
        parted: list[tuple[str, str, str]] = []
        forms = set()
        for key in keys:
            ids = self.old.get(key)
            if ids is not None:
                self.cache[key] = ids
                continue
            core = key[0] if type(key) is tuple else key
            if not self._joins(core):
                odd.append(key)
            elif core is not key:
                alone.append(key)
            elif self.folds:
                form, mark = self._parts(key)
                forms.add(form)
                if form != key:
                    parted.append((key, form, mark))
            else:
                blank.append(key)
        for form in forms.difference(self.cache):
            ids = self.old.get(form)
            if ids is not None:
                self.cache[form] = ids
            else:
                blank.append(form)
        for some, feed, first in ((blank, " ", " " if self.byte_level else ""), (alone, "\n", "")):
            for at in range(0, len(some), ROW_WORDS):
                row = some[at:at + ROW_WORDS]
                found = self._row([k[0] if type(k) is tuple else k for k in row], feed, first)
                if found is None:
                    odd += row
                else:
                    self.cache.update(zip(row, found))
        texts = [k[0] if type(k) is tuple else " " + k if self.byte_level else k for k in odd]
        self.cache.update(zip(odd, self._library(texts)))
        for key, form, mark in parted:
            self.cache[key] = self.cache[form] + self.marks[mark]

    def encode(self, texts: list[str]) -> list[bytes]:
        # The library's tokens form no cycles, but their number sets off many collections.
        collecting = gc.isenabled()
        gc.disable()
        try:
            out, some, size = [], [], 0
            for t in texts:
                some.append(t)
                size += len(t)
                if size >= SPLIT_CHARS:
                    out += self._encode(some)
                    some, size = [], 0
            return out + self._encode(some)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        split = [None if any(s in t for s in self.special) else self.words(t) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.old, self.cache = self.cache, {}
        new = set()
        for words in split:
            if words is not None:
                new.update(words)
        self._learn(new.difference(self.cache))
        known = self.cache.__getitem__
        whole = iter(self._library([t for t, w in zip(texts, split) if w is None]))
        return [next(whole) if w is None else b"".join(map(known, w)) for w in split]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder a worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def release() -> None:
    """Frees the word caches of a worker process that an earlier stage used."""
    _ENCODERS.clear()


def tokenizer_path(name: str) -> str:
    """Place of an installed vocabulary file; it is never copied."""
    import public_tokenizers
    return str(public_tokenizers.path(name))
