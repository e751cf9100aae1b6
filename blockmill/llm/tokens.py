"""Encoding whole texts with a public tokenizer's file, each distinct word once a worker.

The tokenizers cut a text at white space, and between a letter and punctuation, before any merge, so a
text's ids are its pieces' ids in order. Texts are cut and their pieces hashed as arrays of bytes;
workers keep the ids of the pieces they have met (at most MEMO of them) and encode the rest.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pandas as pd

MEMO = 1_500_000
_LONGEST = 256
_encoders: dict = {}
_PROBES = ["It's a \tTEST, isn't it?  No: 12,345.6% of x|y -- (a_b) [c] \"d\" #1 $2 *3 &4;", "\n\nÉtait-ce l'été? Straße 5!\r\n e\u0301 \u4e2d\u6587\u3000x  y", "we'll they've I'm 3rd ... !!! a.b,c;d:e", ""]


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_ALNUM = _flags(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_PUNCT = _flags(b".,;:!?|%$&*#")
_SPACE = _flags(b" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f")
#: Last and first bytes of white space beyond ASCII, and of other characters too.
_BEFORE = _SPACE | _flags(bytes([*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]))
_AFTER = _SPACE | _flags(b"\xc2\xe1\xe2\xe3")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(17)
_VALUES = _rng.integers(1, 1 << 64, 256, np.uint64)
_BASE = int(_rng.integers(1, 1 << 63)) * 2 + 1
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of an odd number modulo 2 to the 64, as many as were asked for."""

    def __init__(self, base: int):
        self.base, self.kept = base, np.ones(1, np.uint64)

    def first(self, n: int) -> np.ndarray:
        while len(self.kept) < n:
            self.kept = np.concatenate([self.kept, self.kept * np.uint64(pow(self.base, len(self.kept), 1 << 64))])
        return self.kept[:n]


_up, _down = _Powers(_BASE), _Powers(_INVERSE)


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    hashes, places = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(hashes, kind="stable")
    return hashes[order], places[order]


class WordEncoder:
    """Ids of texts as uint32 arrays, equal to Tokenizer.encode(text, add_special_tokens=False).ids.

    Texts that hold the string of an added token, in any case, are the library's own. Other tokenizers
    than those that cut as said above are refused; some fixed texts are compared to tell.
    """

    def __init__(self, path: str, memo: int | None = None):
        self.most = memo or MEMO
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        #: byte-level: a piece keeps the blank before it; otherwise white space is dropped
        self.blank = spec["pre_tokenizer"]["type"] == "ByteLevel"
        if not self.blank and spec["model"].get("end_of_word_suffix") != "</w>" or self.blank and spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path}: only tokenizers that cut at white space are supported")
        self.lower = not self.blank and any(x["type"] == "Lowercase" for x in spec["normalizer"]["normalizers"])
        added = sorted({t["content"].lower().encode() for t in spec["added_tokens"]} - {b""})
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None
        self._forget()
        if [x.tolist() for x in self.encode(_PROBES)] != [e.ids for e in self.tokenizer.encode_batch(_PROBES, add_special_tokens=False)]:
            raise ValueError(f"{path}: this tokenizer cuts texts in other places than those supported")

    def _forget(self) -> None:
        #: sorted hashes and their places: most pieces, and those met lately
        self.sorted = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * 2
        self.starts, self.sizes, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _pieces(self, b: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces of the texts b[begin:end], which a line feed parts."""
        if self.blank:
            gap = np.zeros(len(b), bool)
            gap[end] = True
            start = b == 32
        else:
            gap = (b == 32) | (b == 10)
            start = np.zeros(len(b), bool)
            start[1:] = gap[:-1]
        start[1:] |= _ALNUM[b[:-1]] & _PUNCT[b[1:]]
        start[begin] = True
        start &= ~gap
        marks = np.flatnonzero(start | gap)  # ends with the last text's gap
        own = np.flatnonzero(start[marks])
        return marks[own], marks[own + 1]

    def _by_itself(self, b: np.ndarray, first: np.ndarray, last: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Numbers of the texts that aren't the sum of their pieces, or have very long ones."""
        odd = [first[last - first > _LONGEST]]
        if self.added:
            odd.append(np.array([m.start() for m in self.added.finditer(_LOWER[b].tobytes())], np.int64))
        if self.blank:  # a run of white space belongs together
            blank = np.flatnonzero(b == 32)
            blank = blank[(blank > 0) & _BEFORE[b[blank - 1]]]
            odd.append(blank[_AFTER[b[blank + 1]]])  # the last byte is a line feed
        else:  # marks that change a letter
            odd.append(np.flatnonzero((b == 0xCC) | (b == 0xCD)))
        return np.unique(np.searchsorted(begin, np.concatenate(odd), "right") - 1)

    def _known(self, hashes: np.ndarray, b: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Places in starts and sizes of pieces with these distinct hashes."""
        at = np.full(len(hashes), -1)
        for kept, places in self.sorted:
            if len(kept):
                k = np.minimum(np.searchsorted(kept, hashes), len(kept) - 1)
                hit = kept[k] == hashes
                at[hit] = places[k[hit]]
        new = np.flatnonzero(at < 0)
        if len(new):
            if len(self.sizes) + len(new) > self.most and len(self.sizes):
                self._forget()
                return self._known(hashes, b, first, last)
            raw = b.tobytes()
            words = [raw[i:j].decode() for i, j in zip(first[new].tolist(), last[new].tolist(), strict=True)]
            ids = [e.ids for k in range(0, len(words), 2_000) for e in self.tokenizer.encode_batch_fast(words[k : k + 2_000], add_special_tokens=False)]
            sizes = np.array([len(x) for x in ids], np.int64)
            at[new] = len(self.sizes) + np.arange(len(new))
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.pool = np.concatenate([self.pool, np.array([x for e in ids for x in e], np.uint32)])
            most, late = self.sorted
            late = _merged(late, (hashes[new], at[new]))
            self.sorted = [_merged(most, late), (late[0][:0], late[1][:0])] if len(late[0]) > 60_000 else [most, late]
        return at

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode() for t in texts]
        length = np.array([len(r) for r in raw], np.int64)
        b = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        begin = np.cumsum(length + 1) - length - 1
        first, last = self._pieces(b, begin, begin + length)
        alone = self._by_itself(b, first, last, begin)
        if self.lower:
            b = _LOWER[b]
        total = np.zeros(len(b) + 1, np.uint64)
        sums = total[1:]
        np.take(_VALUES, b, out=sums, mode="clip")  # in place: these are the largest arrays
        sums *= _up.first(len(b))
        np.cumsum(sums, out=sums)
        codes, hashes = pd.factorize((total[last] - total[first]) * _down.first(len(b))[first])
        sample = np.empty(len(hashes), np.int64)
        sample[codes[::-1]] = np.arange(len(codes))[::-1]  # where each hash comes first
        order = np.argsort(hashes)  # sorted, they are found faster
        place = np.empty(len(hashes), np.int64)
        place[order] = self._known(hashes[order], b, first[sample[order]], last[sample[order]])
        at = place[codes]
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        ids = self.pool[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.concatenate([np.zeros(1, np.int64), ends])[np.searchsorted(first, np.append(begin, len(b)))].tolist()
        out = [ids[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
        for k in alone.tolist():
            out[k] = np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, np.uint32)
        return out


def encoder(path: str, memo: int | None = None) -> WordEncoder:
    """This worker's encoder for the file; it outlives a task. memo: pieces it may keep from now on."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path, memo)
    _encoders[path].most = memo or MEMO
    return _encoders[path]
