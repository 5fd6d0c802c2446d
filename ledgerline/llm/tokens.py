"""Token ids from a public tokenizer file, with a bounded cache of word pieces.

A text is cut only at places where the tokenizer cuts as well, each distinct
unit goes through the tokenizers library once, and a text's ids are the ids of
its units.  Texts for which those places are not certain are encoded whole.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
from tokenizers import Tokenizer

_BEYOND = re.compile("[̀-\U0010ffff]")
# A word piece ends before ASCII punctuation; only an apostrophe may go on.
_BEFORE_PUNCT = re.compile(r"(?<=[^\W_])(?=[!-&(-/:-@\[-^`{-~])")
_RARE_PUNCT = "!\"#$%&()*+-/:;<=>?@[\\]^`{|}~"
# White space other than single spaces and line ends inside a text.
_SPACE_RUNS = ("  ", "\n\n", " \n", "\n ")
_ODD_SPACES = "\0\t\r\v\f\x1c\x1d\x1e\x1f"
_WIDE_SPACES = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

def _byte_letters() -> dict[int, int]:
    """The letter that byte-level files write for each byte: printable ones as they are, the others from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in kept]
    return {b: b for b in kept} | {b: 0x100 + i for i, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()


def _is_low(text: str) -> bool:
    """No code point from U+0300 on: such text has one normal form, and lower case goes by character."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not _BEYOND.search(text)
    return True


def _set_off_punct(text: str, mark: str) -> str:
    """``text`` with ``mark`` between letters or digits and ASCII punctuation; not before apostrophes."""
    if not any([c in text for c in _RARE_PUNCT]):
        made = text
        for punct in ".,":
            parts = made.split(punct)
            if not all([p[-1:].isalnum() for p in parts[:-1]]):
                break
            made = (mark + punct).join(parts)
        else:
            return made
    return _BEFORE_PUNCT.sub(mark, text)


def _places(values: list) -> list[int]:
    """Where ``values`` has None."""
    places, at = [], -1
    for _ in range(values.count(None)):
        at = values.index(None, at + 1)
        places.append(at)
    return places


#: What the encoders of this process hold, so that a worker's later tasks find the pieces of earlier ones.
_SHARED: dict[tuple, dict] = {}


class CachedEncoder:
    """``ids(texts)`` -> arrays of ids, equal to the library's ``encode_batch`` of whole texts.

    style "word" is for files whose pre-tokenizer drops white space and lower
    cases, "byte" for byte-level files that keep it.
    """

    def __init__(self, path: str, style: str, cache_rows: int = 600_000):
        if style not in ("word", "byte"):
            raise ValueError(f"style {style!r}")
        self.path, self.style, self.cache_rows = path, style, cache_rows

    def __getstate__(self) -> dict:
        return {"path": self.path, "style": self.style, "cache_rows": self.cache_rows}

    def _ready(self) -> None:
        if "_cache" in self.__dict__:
            return
        shared = _SHARED.get((self.path, self.style, self.cache_rows))
        if shared is not None:
            self.__dict__.update(shared)
            return
        self._load()
        _SHARED[self.path, self.style, self.cache_rows] = {k: v for k, v in self.__dict__.items() if k in ("_full", "_cache", "_code", "_special", "dtype")}

    def _load(self) -> None:
        self._full = Tokenizer.from_file(self.path)
        # Special tokens may stand in a text; such a text is not cut.
        special = [t.content for t in self._full.get_added_tokens_decoder().values()]
        self._special = [s.lower() for s in special] if self.style == "word" else special
        # Its own cache would only repeat this one's.
        self._full.model._resize_cache(0)
        self.dtype = np.dtype("<u2" if self._full.get_vocab_size() <= 1 << 16 else "<u4")
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        self._cache: dict[str, bytes] = {}

    def _units(self, text: str) -> list[str] | None:
        low = text.lower() if self.style == "word" else text
        if any([special in low for special in self._special]):
            return None
        if self.style == "word":
            if _is_low(text):
                text = low
            return _set_off_punct(text, " ").replace("\n", " ").split(" ")
        if text[0].isspace() or text[-1].isspace() or any([run in text for run in _SPACE_RUNS]) or any([c in text for c in _ODD_SPACES]):
            return None
        if not text.isascii() and any([c in text for c in _WIDE_SPACES]):
            return None
        return _set_off_punct(text, "\0").replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")

    def _learn(self, units: list[str]) -> dict[str, bytes]:
        """Ids of each unit, which the cache keeps as well."""
        made, dtype = {}, self.dtype
        plain: list[str] = []
        rest: list[str] = []
        for u in units:
            (plain if self._one_piece(u) else rest).append(u)
        tokenize = self._full.model.tokenize
        for u in plain:
            piece = u if u.isascii() and u[0] != " " else u.encode().decode("latin-1").translate(_BYTE_LETTERS)
            made[u] = array(self._code, [t.id for t in tokenize(piece)]).tobytes()
        for u, e in zip(rest, self._full.encode_batch_fast(rest, add_special_tokens=False)):
            made[u] = np.array(e.ids, dtype=dtype).tobytes()
        if len(self._cache) + len(made) > self.cache_rows:
            # The oldest are the most frequent.
            for u in list(self._cache)[self.cache_rows // 3 :]:
                del self._cache[u]
        self._cache.update(made)
        return made

    def _one_piece(self, unit: str) -> bool:
        if self.style == "byte":
            return (unit[1:] if unit[:1] == " " else unit).isalpha()
        return unit.isalpha() and unit.islower() and _is_low(unit)

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; a null text has none."""
        self._ready()
        cut = [self._units(t) if t else [] for t in texts]
        get, out = self._cache.get, []
        found = [list(map(get, units)) if units else [] for units in cut]
        gaps = [(values, units, i) for values, units in zip(found, cut) for i in _places(values)]
        if gaps:
            fresh = self._learn(list({units[i] for _, units, i in gaps}))
            for values, units, i in gaps:
                values[i] = fresh[units[i]]
        for text, units, values in zip(texts, cut, found):
            if units is None:
                out.append(np.array(self._full.encode(text, add_special_tokens=False).ids, dtype=self.dtype))
            else:
                out.append(np.frombuffer(b"".join(values), dtype=self.dtype))
        return out
