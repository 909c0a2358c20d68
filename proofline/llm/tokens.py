"""Token ids of texts by the tokenizers library, from a file given by path.

The vocabularies here split a text before any merge, and always where a visible
character meets white space after it or a letter meets a character of another
kind after it. So a text of usual characters is cut there into units, each
distinct unit is encoded once by the library, and a text's ids are its units'
ids in a row. Units not seen yet are encoded together, in long strings, and told
apart by the bytes that each id stands for.
Texts with rare characters or the text of a special token go to the library
whole. Either way the ids are those of ``encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Sequence
from itertools import compress, repeat
from operator import is_

import numpy as np

_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_UNIT = re.compile(rf"\s*[^\s{_LETTERS}]*[{_LETTERS}]+|\s*[^\s{_LETTERS}]+|\s+")
#: Beyond these the library's and Python's ideas of letters and spaces may differ.
_UNUSUAL = re.compile("[^\t\n\r -~¡-ɏ]")
#: Units kept in memory by a worker: two generations of this many.
_KEPT_UNITS = 400_000
_JOINED_UNITS = 500
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        if hasattr(self._library.model, "_resize_cache"):
            self._library.model._resize_cache(0)  # units come to the library once, so its own memory of words only costs time
        spec = json.load(open(path, encoding="utf-8"))
        pre = spec.get("pre_tokenizer") or {}
        self._by_unit = all(pre.get(k) == v for k, v in _BYTE_LEVEL.items()) and not any(spec.get(k) for k in ("normalizer", "post_processor", "truncation", "padding"))
        self._special = [t["content"] for t in spec.get("added_tokens", [])]
        vocabulary = self._library.get_vocab(with_added_tokens=True)
        self._bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # at byte level each character of a token is a byte
            self._bytes[i] = len(token)
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self._library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, units: set[str]) -> None:
        """Encode units that begin with white space, joined; others alone."""
        joined = [u for u in units if u[0] <= " " < u[-1]]
        alone = [u for u in units if not u[0] <= " " < u[-1]]
        self._new.update(zip(alone, self._whole(alone), strict=True))
        if not joined:
            return
        texts = ["".join(joined[k : k + _JOINED_UNITS]) for k in range(0, len(joined), _JOINED_UNITS)]
        ids = b"".join(self._whole(texts))
        widths = np.where(np.frombuffer("".join(texts).encode("utf-32-le"), "<u4") < 128, 1, 2)  # a usual character has one or two bytes
        borders = np.cumsum(widths)[np.cumsum(np.fromiter(map(len, joined), np.int64, len(joined))) - 1]
        ends = np.cumsum(self._bytes[np.frombuffer(ids, "<u4")])
        at = np.minimum(np.searchsorted(ends, borders), len(ends) - 1)
        if not np.array_equal(ends[at], borders):
            raise ValueError("this tokenizer merges across white space")
        stops = ((at + 1) * 4).tolist()
        self._new.update(zip(joined, [ids[i:j] for i, j in zip([0, *stops[:-1]], stops, strict=True)], strict=True))

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        collecting = gc.isenabled()
        gc.disable()  # long lists of texts hold no cycles, and looking for some takes a tenth of the time
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: Sequence[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        whole, cut = [], []
        for k, text in enumerate(texts):
            if text:
                usual = self._by_unit and not (not text.isascii() and _UNUSUAL.search(text) or text.isascii() and not text.isprintable() and _UNUSUAL.search(text))
                (cut if usual and not any(s in text for s in self._special) else whole).append(k)
        for k, ids in zip(whole, self._whole([texts[k] for k in whole]), strict=True):
            out[k] = ids
        if len(self._new) > _KEPT_UNITS:
            self._old, self._new = self._new, {}
        new, old, find = self._new, self._old, _UNIT.findall
        begun, missing = [], set()
        for k in cut:
            units = find(texts[k])
            ids = list(map(new.get, units))
            if None in ids:  # units not seen yet, and only those, are looked up again
                gaps = list(compress(range(len(ids)), map(is_, ids, repeat(None))))
                lacking = [units[j] for j in gaps]
                missing.update(lacking)
                begun.append((k, ids, gaps, lacking))
            else:
                out[k] = b"".join(ids)
        new.update([(u, old[u]) for u in missing if u in old] if old else ())
        self._learn(missing.difference(new))
        for k, ids, gaps, lacking in begun:
            for j, unit in zip(gaps, lacking, strict=True):
                ids[j] = new[unit]
            out[k] = b"".join(ids)
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each path and worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Lets go of a worker's encoders and the units that they keep; the next text to encode brings them back."""
    _ENCODERS.clear()


def slices(texts: list, chars: int = 4_000_000, rows: int = 1_000_000):
    """Ranges of a list of texts of about so many characters, and at most so many texts, each."""
    start = size = 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= chars or k + 1 - start >= rows:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)
