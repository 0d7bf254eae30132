"""Tokenizer files applied to whole texts, each distinct piece of text once.

Both byte-pair vocabularies split a text before merging, and never join text across the start
of a run of blanks, nor from a letter to ASCII punctuation. Between two such boundaries the ids
depend on the characters there alone. A batch of texts is cut at blanks on its UTF-8 bytes, all
pieces are hashed at once (64 bits), and the ids of pieces seen before come from a table sorted
by hash; only new pieces become strings and go to the library, plain words in one string where
the ids that begin or end a word tell them apart. A text with white space whose splitting is
not that simple is given to the library as a whole.
"""

from __future__ import annotations

import re
import zlib

import numpy as np

from vaultframe.llm.common import loaded, segment_hashes, text_parts

#: White space that the splitting patterns know, beside the plain blank, tab, line feed and carriage return.
_OTHER_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARK = r"!-/:-@\[-`{-~"
_BLANK = r" \t\n\r"
#: A piece's parts: a line feed before a word, a word before punctuation, and the rest.
_PARTS = re.compile(rf"\n(?=[^{_BLANK}])|[{_BLANK}]*[{_LETTER}]++(?=[{_MARK}])|[{_BLANK}]*[^{_BLANK}]+|[{_BLANK}]+")
_PLAIN = re.compile(f" [{_LETTER}]+")
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[9, 10, 13, 32]] = True
#: Bytes that may belong to other white space; such texts are looked at as strings.
_SUSPECT = np.zeros(256, bool)
_SUSPECT[[0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0xE1, 0xE2, 0xE3]] = True
#: Pieces in the table, some 30 bytes each, and parts of pieces; both start afresh beyond.
PIECES, PARTS = 2_000_000, 200_000


class TextEncoder:
    """ids of texts as the library gives them without special tokens.

    keeps_space: the vocabulary's ids include white space (byte-level), else it is dropped.
    """

    def __init__(self, path: str, keeps_space: bool, dtype: str = "<u4"):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype(dtype)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        if max(vocabulary.values()) > np.iinfo(self.dtype).max:
            raise ValueError(f"ids do not fit {dtype}")
        self.keeps_space = keeps_space
        #: ids that begin a word (byte-level) or end one
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self.edge[[i for t, i in vocabulary.items() if (t.startswith("Ġ") if keeps_space else t.endswith("</w>"))]] = True
        self.parts: dict[str, np.ndarray] = {}
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, self.dtype), 0

    def direct(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _bulk(self, words: list[str]) -> list[np.ndarray] | None:
        """ids of plain words, each led by a blank."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, self.dtype)
        edges = np.flatnonzero(self.edge[ids])
        if len(edges) != len(words):
            return None
        bounds = [*edges.tolist(), len(ids)] if self.keeps_space else [0, *(edges + 1).tolist()]
        return [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _learn(self, pieces: list[str]) -> list[np.ndarray]:
        """ids of new pieces."""
        found: list[np.ndarray | None] = [None] * len(pieces)
        plain = [k for k, p in enumerate(pieces) if _PLAIN.fullmatch(p)]
        if plain and (ids := self._bulk([pieces[k] for k in plain])):
            for k, v in zip(plain, ids, strict=True):
                found[k] = v
        cut = {k: _PARTS.findall(pieces[k]) for k in range(len(pieces)) if found[k] is None}
        new = set().union(*cut.values()).difference(self.parts)
        if len(self.parts) + len(new) > PARTS:
            self.parts = {}
            new = set().union(*cut.values())
        words = [p for p in new if _PLAIN.fullmatch(p)]
        if words and (ids := self._bulk(words)):
            self.parts.update(zip(words, ids, strict=True))
        for p in new:
            if p not in self.parts:
                self.parts[p] = self.direct(p)
        for k, parts in cut.items():
            found[k] = np.concatenate([self.parts[p] for p in parts])
        return found

    def _add(self, hashes: np.ndarray, ids: list[np.ndarray]) -> None:
        """hashes: ascending and new."""
        size = np.array([len(i) for i in ids])
        flat = np.concatenate(ids)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(self.pool), len(flat)), self.dtype)])
        self.pool[self.used : self.used + len(flat)] = flat
        k = np.searchsorted(self.hashes, hashes)
        self.at = np.insert(self.at, k, self.used + np.cumsum(size) - size)
        self.size = np.insert(self.size, k, size)
        self.hashes = np.insert(self.hashes, k, hashes)
        self.used += len(flat)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's ids start and end) for UTF-8 bytes and text offsets."""
        out, counts = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for _, part, bounds in text_parts(data, offsets):
            ids, n = self._encode_part(part, bounds)
            out.append(ids)
            counts.append(n)
        return np.concatenate(out), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)

    def _encode_part(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n_texts = len(offsets) - 1
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(n_texts, np.int64)
        suspect = _SUSPECT[data]
        suspect[:-1] |= (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
        whole: dict[int, np.ndarray] = {}
        for k in np.unique(np.searchsorted(offsets, np.flatnonzero(suspect), "right") - 1):
            text = data[offsets[k] : offsets[k + 1]].tobytes().decode()
            if _OTHER_SPACE.search(text):
                whole[int(k)] = self.direct(text)
        blank = _IS_BLANK[data]
        first = np.zeros(len(data), bool)
        first[1:] = blank[1:] & ~blank[:-1]
        first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(first)
        text_of = np.searchsorted(offsets, starts, "right") - 1
        ends = np.append(starts[1:], len(data))
        if whole:
            keep = ~np.isin(text_of, np.fromiter(whole, np.int64))
        hashes = segment_hashes(data, starts, first)
        if whole:
            hashes, starts, ends, text_of = hashes[keep], starts[keep], ends[keep], text_of[keep]
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > PIECES:
            self._clear()
        k = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = k < len(self.hashes)
        known[inside] = self.hashes[k[inside]] == distinct[inside]
        if not known.all():
            raw = data.tobytes()
            new = np.flatnonzero(~known)
            a, b = starts[where[new]].tolist(), ends[where[new]].tolist()
            self._add(distinct[new], self._learn([raw[x:y].decode() for x, y in zip(a, b, strict=True)]))
            k = np.searchsorted(self.hashes, distinct)
        size, at = self.size[k][inverse], self.at[k][inverse]
        total = np.cumsum(size)
        ids = self.pool[np.arange(total[-1] if len(total) else 0) + np.repeat(at - total + size, size)]
        counts = np.bincount(text_of, size, n_texts).astype(np.int64)
        if whole:
            bounds = np.concatenate([[0], np.cumsum(counts)])
            parts = [whole.get(i, ids[bounds[i] : bounds[i + 1]]) for i in range(n_texts)]
            return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, counts


def crc32_of(ids: bytes | memoryview) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF


def encoder(path: str, keeps_space: bool, dtype: str = "<u4") -> TextEncoder:
    """The worker's own encoder, loaded once."""
    return loaded(("encoder", path, keeps_space, dtype), lambda: TextEncoder(path, keeps_space, dtype))
