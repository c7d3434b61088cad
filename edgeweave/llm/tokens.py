"""Token ids of texts with a public tokenizer, with a bounded cache of encoded units.

The byte-level pattern never lets a token cross from a non-space character into
the white space after it; a single space before a non-space character belongs
to what follows, and a single line break between two non-space characters is a
token of its own. So a text can be cut at every space or line break that has
non-space characters on both sides, and the units encoded on their own; the ids
are those of the whole text. Units recur, so most cost one look-up. New units
are cut by the tokenizer's own pattern and encoded by the library's model; units
beyond Latin letters go through the whole library.

The caches hold units of at most ``LONG`` characters, so that their bound on
entries bounds their bytes too.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from operator import attrgetter

import numpy as np
import public_tokenizers
import regex

#: Entries of a cache before its older half goes; they bound a worker's memory (about 170 bytes an entry). No result depends on them.
UNITS, TOKENS = 400_000, 100_000
#: Longer units are encoded anew each time.
LONG = 64
_CUT = re.compile(r"(?<=\S)([ \n])(?=\S)")
_MARKS = frozenset(".,;:!?")
_SAVED: dict[str, Encoder] = {}


class _Gap(ValueError):
    """A unit that is empty or has white space at an end: the cuts beside it don't hold."""


class _Units(dict):
    """Encoded units in two generations: when the younger is full it becomes the older one."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.half, self.old = encode, most // 2, {}

    def __missing__(self, unit: str) -> bytes:
        out = self.old.pop(unit, None) or self.encode(unit)
        if len(unit) <= LONG:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[unit] = out
        return out


_id = attrgetter("id")


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True  # their strings in a text are ordinary text
        own = json.loads(self.whole.to_str())["model"]
        # the library's model without a cache of its own, as the caches here stand before it
        self.model = models.BPE(vocab=own["vocab"], merges=[tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in own["merges"]], cache_capacity=0)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.space = _byte_letters()[32]
        self.letters = str.maketrans({b: c for b, c in enumerate(_byte_letters())})
        self.tokens = _Units(self._token, TOKENS)
        self.later, self.start = _Units(self._later, UNITS), _Units(self._start, UNITS // 8)
        self.line = self._token("\n")

    def _token(self, token: str) -> bytes:
        return self._ids(token.encode().decode("latin-1").translate(self.letters))

    def _ids(self, shown: str) -> bytes:
        ids = array("I", map(_id, self.model.tokenize(shown)))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _later(self, unit: str) -> bytes:
        """A unit after a space."""
        if unit.isalpha():
            # letters after at most one space are one token, and so is a mark after them
            if unit.isascii():
                return self._ids(self.space + unit)  # ASCII letters stand for themselves
            if max(unit) < "ɐ":
                return self._ids(self.space + unit.encode().decode("latin-1").translate(self.letters))
        elif unit[-1:] in _MARKS and (word := unit[:-1]).isalpha() and (word.isascii() or max(word) < "ɐ"):
            return self.later[word] + self.tokens[unit[-1]]
        return self._unit(unit, " ")

    def _start(self, unit: str) -> bytes:
        return self._unit(unit, "")

    def _unit(self, unit: str, lead: str) -> bytes:
        if not unit or unit[0].isspace() or unit[-1].isspace():
            raise _Gap
        return self._any(lead + unit)

    def _any(self, text: str) -> bytes:
        if text.isascii() or max(text) < "ɐ":
            return b"".join(map(self.tokens.__getitem__, self.pattern.findall(text)))
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        out, later, start = [], self.later.__getitem__, self.start.__getitem__
        try:
            for line in text.split("\n"):
                units = line.split(" ")
                out.append(start(units[0]))
                out += map(later, units[1:])
                out.append(self.line)
            out.pop()
        except _Gap:
            parts = _CUT.split(text)
            out = [self._any(parts[0])]
            for cut, unit in zip(parts[1::2], parts[2::2], strict=True):
                whole = not unit[-1].isspace()  # only the last unit can end in white space
                if cut == "\n":
                    out += [self.line, start(unit) if whole else self._any(unit)]
                else:
                    out.append(later(unit) if whole else self._any(cut + unit))
        return b"".join(out)


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself if it is printable, else one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def encoder(path: str) -> Encoder:
    """One encoder a worker process and path."""
    if path not in _SAVED:
        _SAVED[path] = Encoder(path)
    return _SAVED[path]


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")
