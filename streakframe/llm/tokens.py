"""Token ids of whole texts with a public tokenizer file, as arrays.

A text is cut where a word meets a following space: neither tokenizer family used here (white space dropped, or a space
led by its word) merges across such a place, so the ids of the pieces in a row are the ids of the text. Pieces repeat and are
looked up; those not met yet go to the tokenizers library. Its whole encoder takes several times as long as its merges, so
for pieces of ASCII and Latin-1 letters, where normal forms and character classes leave no doubt, the piece is split by the
file's own pattern and only the merges are left to the library; every other piece takes the library's encoder. Look-up tables
are emptied at a bound of bytes, whatever the length of their pieces.
"""

from __future__ import annotations

import json
import re
from array import array
from sys import getsizeof

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from tokenizers import Tokenizer

_PLACE = re.compile(r"(?<=\S)(?= )")
#: Pieces for which splitting here and in the library agree: printable ASCII, line feeds, letters of Latin-1.
_PLAIN = re.compile(r"[\n\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
#: White space at either end or before a space: such texts are cut one by one.
_WHITE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD = f"^{_WHITE}|{_WHITE}$|{_WHITE} "
#: Bytes of text that are worked on at once.
_CHUNK = 4 << 20
#: Bytes of a worker's look-up tables, and of an entry besides its key and ids: its place in the table.
_PIECES, _WORDS, _PLACES = 192 << 20, 32 << 20, 64
_open: dict[str, Encoder] = {}


def _alphabet() -> dict[int, int]:
    """The character that stands for each byte: itself if it can be seen, else one from 256 on, in order."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in seen]
    return {b: 256 + k for k, b in enumerate(hidden)}


_BYTES = _alphabet()
_SPACE = chr(_BYTES[32])


class Encoder:
    """Encodes texts with the tokenizer file `name`; no special tokens are added."""

    def __init__(self, name: str) -> None:
        path = public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        # ids as bytes: nothing in the look-up tables is walked by the garbage collector, and a text's ids are one join
        self.led: dict[str, bytes] = {}  # of a piece with a space before it
        self.words: dict[str, bytes] = {}
        self.led_bytes = self.words_bytes = 0
        self.share = 1.0  # of the tables' bounds
        with open(path) as f:
            kept = json.load(f)
        split = kept["pre_tokenizer"].get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        steps = [] if kept["normalizer"] is None else [s["type"] for s in kept["normalizer"]["normalizers"]]
        self.lower = "Lowercase" in steps
        plain = kept["pre_tokenizer"]["type"] == "ByteLevel" and kept["pre_tokenizer"]["use_regex"] and not kept["pre_tokenizer"]["add_prefix_space"]
        self.split = regex.compile(split or public_tokenizers.PATTERN).findall
        self.drops = bool(split)  # white space is no part of any word
        self.short = (bool(split) or plain) and set(steps) <= {"NFC", "Replace", "Lowercase"}
        self.added = [t["content"] for t in kept["added_tokens"]]

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of what the file's pattern gives as one word."""
        seen = word if word.isascii() and word.isalpha() else word.encode().decode("latin-1").translate(_BYTES)
        return array("I", [t.id for t in self.merges.tokenize(seen)]).tobytes()

    def _new(self, piece: str) -> bytes:
        """Ids of any piece, with the space that leads it."""
        if not self.short or not _PLAIN.fullmatch(piece):
            return self._whole(piece)
        led, words, out = self.led, self.words, []
        for w in self.split(piece.lower() if self.lower else piece):
            # a word with its space may have come alone
            ids = led.get(w[1:]) if w[0] == " " else words.get(w)
            if ids is None:
                ids = self._word(w)
                if w[0] != " ":
                    words[w] = ids
                    self.words_bytes += getsizeof(w) + getsizeof(ids) + _PLACES
            out.append(ids)
        return b"".join(out)

    def _led(self, name: str) -> bytes:
        """Ids of a piece that a space leads, given without it. Most are ASCII letters alone, and so one word."""
        if self.short and name.isascii() and name.isalpha():
            return self._word(name.lower() if self.lower else name) if self.drops else self._word_led(name)
        return self._new(" " + name)

    def _word_led(self, name: str) -> bytes:
        return array("I", [t.id for t in self.merges.tokenize(_SPACE + name)]).tobytes()

    def _piecewise(self, text: str) -> np.ndarray:
        if any(a in text for a in self.added):
            return np.frombuffer(self._whole(text), np.uint32)
        return np.frombuffer(b"".join(map(self._new, _PLACE.split(text))), np.uint32)

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, unsigned 32-bit integers; null is the empty text."""
        texts = texts.fill_null("")
        size, out = pc.binary_length(texts).to_numpy(zero_copy_only=False), []
        part = np.cumsum(size) // _CHUNK
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            out += self._chunk(texts.slice(start, stop - start))
        return out

    def _trim(self) -> None:
        """Empties the tables that have reached their bounds; new entries before the next call come from one chunk."""
        if self.led_bytes > _PIECES * self.share:
            self.led.clear()
            self.led_bytes = 0
        if self.words_bytes > _WORDS * self.share:
            self.words.clear()
            self.words_bytes = 0

    def _chunk(self, texts: pa.Array) -> list[np.ndarray]:
        odd = pc.match_substring_regex(texts, _ODD)
        for a in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, a))
        odd = odd.to_numpy(zero_copy_only=False)
        out = [self._piecewise(t.as_py()) if o else None for t, o in zip(texts, odd, strict=True)]
        even = np.flatnonzero(~odd)
        if not len(even):
            return out
        parts = pc.split_pattern(texts.take(pa.array(even)), " ")
        first = parts.offsets.to_numpy()
        coded = parts.values.dictionary_encode()
        which, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        self._trim()
        known = self.led
        found = list(map(known.get, names))
        if None in found:
            for k, ids in enumerate(found):
                if ids is None:
                    found[k] = known[names[k]] = self._led(names[k])
                    self.led_bytes += getsizeof(names[k]) + getsizeof(found[k]) + _PLACES
        # a text's first part has no space before it
        found += [self._new(names[k]) for k in which[first[:-1]]]
        which[first[:-1]] = np.arange(len(names), len(found))
        length = np.fromiter(map(len, found), np.int64, len(found)) // 4
        every, start = np.frombuffer(b"".join(found), np.uint32), np.cumsum(length) - length
        count = length[which]
        end = np.cumsum(count)
        ids = every[np.repeat(start[which] - (end - count), count) + np.arange(int(end[-1]))]
        bounds = np.concatenate(([0], end))[first]
        for k, a, b in zip(even.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out[k] = ids[a:b]
        return out


def encoder(name: str, share: float = 1.0) -> Encoder:
    """One for each worker process and file; its look-up tables take that share of their bounds."""
    if name not in _open:
        _open[name] = Encoder(name)
    _open[name].share = share
    return _open[name]
