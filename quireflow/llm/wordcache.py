"""Whole-text encoding with the tokenizers library, through a cache of white-space-delimited pieces.

A byte-level or word BPE never lets a token cross from a non-space character to
the white space after it, so a text is cut there into pieces (white space plus
the word after it) that can be encoded alone. Each batch hashes its pieces with
numpy, encodes the pieces not seen before with the library (many in one call),
and gathers the ids of all pieces from one flat array. Texts in which another
character counts as white space, or in which a special token's string may
stand, are encoded whole by the library.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import itemgetter
from pathlib import Path

import numpy as np
import pyarrow as pa

from quireflow.llm import textkit

#: White space for the tokenizers' patterns but not for textkit.SPACE, a context-dependent capital, or the start of a special token.
_WHOLE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‏    ⁠　Σ﻿]|<\\|")
#: The same as bytes that may begin such characters; texts without them need no search.
_SUSPECT = np.zeros(256, bool)
_SUSPECT[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xCE, 0xE1, 0xE2, 0xE3, 0xEF, 0x7C]] = True
_FIRST = itemgetter(0)
#: Entries of the cache; beyond it those that were met only once are dropped. Bounds a Python worker's memory.
CACHE_ENTRIES = 2_000_000


class PieceEncoder:
    """Encodes columns of texts; one per tokenizer file and Python worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = self.tokenizer.encode(" a", add_special_tokens=False).ids != self.tokenizer.encode("a", add_special_tokens=False).ids
        self.sizes = self._token_bytes()
        self.clear()

    def _token_bytes(self) -> np.ndarray:
        """Bytes of text that each id stands for (white space aside, where it is dropped)."""
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, k in vocabulary.items():
            sizes[k] = len(token if self.spaced else token.removesuffix("</w>"))  # a letter of a token is a byte
        return sizes

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.offsets = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int32)
        self.again = np.zeros(0, bool)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _shrink(self) -> None:
        """Keep the entries that were met again, if they are at most half of the cache."""
        kept = np.flatnonzero(self.again)
        if 2 * len(kept) > CACHE_ENTRIES:
            self.clear()
            return
        keys, lengths = self.keys[kept], self.lengths[kept]
        ids = textkit.ragged_gather(self.ids, self.offsets[kept], lengths.astype(np.int64))
        self.clear()
        self.keys, self.lengths, self.again = keys, lengths, np.zeros(len(keys), bool)
        self.offsets = self._add(ids) + np.cumsum(lengths, dtype=np.int64) - lengths

    def _add(self, ids: np.ndarray) -> int:
        at = self.used
        if at + len(ids) > len(self.ids):
            grown = np.zeros(max(2 * len(self.ids), at + len(ids)), np.uint32)
            grown[:at] = self.ids[:at]
            self.ids = grown
        self.ids[at : at + len(ids)] = ids
        self.used = at + len(ids)
        return at

    @staticmethod
    def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, extra: int) -> str:
        """The pieces as one text, each followed by so many spaces."""
        lengths = ends - starts
        before = np.cumsum(lengths) - lengths
        out = np.full(int(lengths.sum()) + extra * len(starts), 32, np.uint8)
        inside = np.arange(int(lengths.sum()))
        out[inside + np.repeat(extra * np.arange(len(starts)), lengths)] = data[inside + np.repeat(starts - before, lengths)]
        return out.tobytes().decode()

    def _encode_new(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of new pieces, flat, how many each has, and the order in which they come.

        Pieces that start with white space (all, where it is dropped) are
        encoded as one text, and its tokens are dealt out by the bytes that they
        stand for; by their offsets where letters may change.
        """
        # white space at a text's end would join with that of the next piece
        lead = textkit.SPACE[data[starts]] & ~textkit.SPACE[data[ends - 1]] if self.spaced else np.ones(len(starts), bool)
        together, alone = np.flatnonzero(lead), np.flatnonzero(~lead)
        ids, counts = [], np.zeros(len(starts), np.int64)
        extra = 0 if self.spaced else 1  # a space after each piece
        if not self.spaced:  # case and composition may change the bytes of other letters
            ascii_only = np.concatenate([[0], np.cumsum(data >> 7, dtype=np.int64)])
            whole = ascii_only[ends] == ascii_only[starts]
            together, odd = together[whole[together]], together[~whole[together]]
        for at in range(0, len(together), 20_000):
            part = together[at : at + 20_000]
            joined = self._joined(data, starts[part], ends[part], extra)
            (encoded,) = self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)
            found = np.array(encoded.ids, np.uint32)
            ends_at, bounds = np.cumsum(self.sizes[found]), np.cumsum(ends[part] - starts[part])
            if (ends_at[-1] if len(ends_at) else 0) != bounds[-1]:
                raise ValueError("tokens don't add up to the text")
            counts[part] = np.diff(np.searchsorted(ends_at, bounds, "right"), prepend=0)
            ids.append(found)
        if not self.spaced:
            characters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            for at in range(0, len(odd), 20_000):
                part = odd[at : at + 20_000]
                encoded = self.tokenizer.encode(self._joined(data, starts[part], ends[part], extra), add_special_tokens=False)
                bounds = np.cumsum(characters[ends[part]] - characters[starts[part]] + extra)
                places = np.fromiter(map(_FIRST, encoded.offsets), np.int64, len(encoded.ids))
                counts[part] = np.bincount(np.searchsorted(bounds, places, "right"), minlength=len(part))
                ids.append(np.array(encoded.ids, np.uint32))
            together = np.concatenate([together, odd])
        for at in range(0, len(alone), 5_000):
            part = alone[at : at + 5_000]
            texts = [data[a:b].tobytes().decode() for a, b in zip(starts[part].tolist(), ends[part].tolist(), strict=True)]
            for k, e in zip(part.tolist(), self.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
                ids.append(np.array(e.ids, np.uint32))
                counts[k] = len(e.ids)
        order = np.concatenate([together, alone])
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), counts[order], order

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and the first piece of each row. A piece is white space and the word after it, or white space at a row's end."""
        starts, ends, first = textkit.word_spans(data, offsets)
        if not self.spaced:
            return starts, ends, first
        begin = np.empty(len(starts), np.int64)
        if len(starts):
            begin[0] = 0
            begin[1:] = ends[:-1]
        row_first = first[:-1][first[:-1] < first[1:]]
        begin[row_first] = offsets[:-1][first[:-1] < first[1:]]
        last = np.where(first[1:] > first[:-1], ends[np.maximum(first[1:] - 1, 0)] if len(ends) else 0, offsets[:-1])
        tail = np.flatnonzero(last < offsets[1:])  # rows that end in white space
        if len(tail):
            begin, ends = np.concatenate([begin, last[tail]]), np.concatenate([ends, offsets[1:][tail]])
            order = np.argsort(begin, kind="stable")
            begin, ends = begin[order], ends[order]
        return begin, ends, np.searchsorted(begin, offsets)

    def _run(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, flat, and how many each row has."""
        starts, ends, first = self._pieces(data, offsets)
        hashes = textkit.span_hashes(data, starts, ends)
        unique, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(unique) > CACHE_ENTRIES:
            self._shrink()
        at = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == unique[inside]
        new = np.flatnonzero(~known)
        if len(new):
            ids, counts, order = self._encode_new(data, starts[where[new]], ends[where[new]])
            new = new[order]
            base = self._add(ids)
            offsets, order = base + np.cumsum(counts) - counts, np.argsort(new)
            new, offsets, counts = new[order], offsets[order], counts[order].astype(np.int32)  # by key, as unique is
            self.again[at[known]] = True
            places = at[new]
            self.keys, self.offsets, self.lengths, self.again = (np.insert(x, places, y) for x, y in ((self.keys, unique[new]), (self.offsets, offsets), (self.lengths, counts), (self.again, False)))
            at = at + np.concatenate([[0], np.cumsum(~known)])[:-1]  # so many keys were put before each
        else:
            self.again[at] = True
        lengths = self.lengths[at][inverse].astype(np.int64)
        flat = textkit.ragged_gather(self.ids, self.offsets[at][inverse], lengths)
        sums = np.concatenate([[0], np.cumsum(lengths)])
        return flat, sums[first[1:]] - sums[first[:-1]]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _segments(self, data: np.ndarray) -> Iterator[np.ndarray]:
        """A very long text cut where white space begins, for bounded memory."""
        at, n = 0, len(data)
        while n - at > textkit.CHUNK_BYTES:
            window = data[at : at + textkit.CHUNK_BYTES]
            space = textkit.SPACE[window]
            cuts = np.flatnonzero(space[1:] & ~space[:-1]) + 1
            if not len(cuts):
                cut = np.flatnonzero(textkit.SPACE[data[at:]])
                cuts = cut[cut > 0][:1]
                if not len(cuts):
                    break
            yield data[at : at + int(cuts[-1])]
            at += int(cuts[-1])
        yield data[at:]

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, flat ids, ids per row) for slices of the column, whole texts; nulls count as empty."""
        data, offsets = textkit.column_buffer(column)
        for low, high in textkit.row_slices(offsets):
            part, bounds = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
            odd = np.zeros(high - low, bool)
            if _SUSPECT[part].any():
                for r in np.unique(np.searchsorted(bounds, np.flatnonzero(_SUSPECT[part]), "right") - 1):
                    odd[r] = _WHOLE.search(part[bounds[r] : bounds[r + 1]].tobytes().decode()) is not None
            if high - low == 1 and not odd[0] and len(part) > textkit.CHUNK_BYTES:
                pieces = [self._run(x, np.array([0, len(x)]))[0] for x in self._segments(part)]
                flat = np.concatenate(pieces)
                yield low, flat, np.array([len(flat)])
                continue
            if not odd.any():
                flat, counts = self._run(part, bounds)
                yield low, flat, counts
                continue
            keep = np.repeat(~odd, np.diff(bounds))
            sizes = np.where(odd, 0, np.diff(bounds))
            flat, counts = self._run(part[keep], np.concatenate([[0], np.cumsum(sizes)]))
            rows = np.split(flat, np.cumsum(counts)[:-1])
            for r in np.flatnonzero(odd):
                rows[r] = self._whole(part[bounds[r] : bounds[r + 1]].tobytes().decode())
            yield low, np.concatenate(rows), np.array([len(x) for x in rows])


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a tokenizer file; kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def release() -> None:
    """Give up this worker's encoders and their memory; for stages that follow the encoding."""
    _ENCODERS.clear()


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(Path(path))).get_vocab_size()
