"""Quality rules by tokeniser fertility.

A public piece vocabulary measures each text: code points per token, share of byte-fallback
tokens (line feeds apart), and entropy of the token distribution in bits. Each language or
script has a band for each measure; a text outside a band is rejected, whatever its length. The
lower bounds of short texts are wider, as their measures scatter. Before that the base rules
reject texts that are short or repeat themselves.

Base counts: ``n_words`` and ``word_chars`` (words are runs of anything but blank, tab, line
feed, vertical tab, form feed and carriage return; code points in them), ``n_symbols``,
``n_dup_lines`` (lines with a word that equal an earlier line of the text) and
``n_repeat_words`` (words in windows of eight words that the text has twice or more, the first
included).

Cases: null text: no words, so the base rules reject it; measures are then null. A text in a
language without a band of its own, or null, is judged by the band of Latin script if no more
than half of its letters are of other scripts, and else by the default band. Repeated rows are judged
alike, other columns are not carried by ``measure`` and are kept by ``keep_documents``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultframe.llm.common import CACHE_ENTRIES, CACHE_WORD_CHARS, loaded, map_batches, tune
from vaultframe.llm.piece_codec import SPACE, PieceCodec

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


@dataclass(frozen=True)
class Band:
    """Least and most code points per token, most byte-fallback share, least and most entropy in bits.

    At n tokens the lower bounds are less by their scatter, divided by the square root of n.
    """

    chars_low: float
    chars_high: float
    byte_high: float
    entropy_low: float
    entropy_high: float
    chars_scatter: float = 0.0
    entropy_scatter: float = 0.0

    def admits(self, n: int, chars: float, fallback: float, entropy: float) -> bool:
        root = n**0.5
        return self.chars_low - self.chars_scatter / root <= chars <= self.chars_high and fallback <= self.byte_high and self.entropy_low - self.entropy_scatter / root <= entropy <= self.entropy_high


#: Bands by language; "Latn" is for any other language in Latin script, "" for other scripts (no
#: labelled text has one, so that band is wide). Prose of a language keeps above its own bounds;
#: marks strewn in, capitals and tables break words into more tokens, and repetitive text has low
#: entropy.
BANDS = {
    "en": Band(2.48, 6.5, 0.05, 6.92, 13.0, 7, 17),
    "de": Band(2.48, 6.5, 0.05, 6.80, 13.0, 7, 17),
    "fr": Band(2.35, 6.5, 0.05, 6.73, 13.0, 7, 17),
    "es": Band(2.28, 6.5, 0.05, 6.72, 13.0, 7, 17),
    "Latn": Band(2.28, 6.5, 0.05, 6.72, 13.0, 7, 17),
    "": Band(0.3, 8.0, 0.90, 2.0, 14.0),
}

_LETTER = re.compile(r"[^\W\d_]")
_LATIN = re.compile("[A-Za-z\u00aa\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u1e00-\u1eff]")
_WEIGHTS = np.array([pow(0x9E3779B97F4A7C15, k, 2**64) for k in range(1, WINDOW + 1)], np.uint64)


def repeat_words(words: list, window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words which occurs twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    mixed = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    h = mixed[:n] * _WEIGHTS[0]
    for k in range(1, window):
        h += mixed[k : k + n] * _WEIGHTS[k % WINDOW]
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    # an equal hash is checked against the words themselves
    seen: dict = {}
    for i in np.flatnonzero(np.isin(h, twice)).tolist():
        seen.setdefault(tuple(words[i : i + window]), []).append(i)
    covered = np.zeros(len(words) + 1, np.int64)
    for at in seen.values():
        if len(at) > 1:
            np.add.at(covered, at, 1)
            np.add.at(covered, np.array(at) + window, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()  # bytes split at the six ASCII white-space characters only
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    dup, seen = 0, set()
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.encode().strip():
            seen.add(line)
    return len(words), chars, sum(map(text.count, SYMBOLS)), dup, repeat_words(words)


class Fertility:
    """Token measures of whole texts under one vocabulary.

    Texts are cut where no piece reaches over, and each distinct span is encoded once as long as it
    is known. New plain words go to the library together: each begins one token with the space mark.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.codec = PieceCodec(path)
        self.library = SentencePieceProcessor(model_file=path)
        self.starts = np.array([p[0] == SPACE for p in self.codec.pieces])
        self.known: dict[str, bytes] = {}
        self.fallback = np.zeros(len(self.codec.pieces), bool)
        self.fallback[[i for b, i in self.codec.byte_id.items() if b != 10]] = True

    def _learn(self, spans: set[str]) -> None:
        """Makes all of the spans known; forgets others when there are too many."""
        new = spans.difference(self.known)
        if len(self.known) + len(new) > CACHE_ENTRIES:
            self.known = {s: self.known[s] for s in spans if s in self.known}
        plain = [s for s in new if s[0] == SPACE and s[1:].isalpha() and len(s) <= CACHE_WORD_CHARS]
        for i in range(0, len(plain), 4096):
            words = plain[i : i + 4096]
            ids = np.array(self.library.encode("".join(words)[1:].replace(SPACE, " ")), "<u4")
            at = (4 * np.flatnonzero(self.starts[ids])).tolist()
            if len(at) != len(words):
                raise AssertionError("a plain word does not begin one token")
            raw = ids.tobytes()
            self.known.update(zip(words, (raw[s:e] for s, e in zip(at, [*at[1:], len(raw)], strict=True)), strict=True))
        for s in new.difference(plain):
            self.known[s] = np.array(self.codec.ids(s), "<u4").tobytes()

    def measures(self, texts: list[str | None]) -> list[tuple[int, float | None, float | None, float | None]]:
        """(tokens, code points per token, byte-fallback share, entropy in bits) of each text."""
        out = []
        for i in range(0, len(texts), 128):
            part = texts[i : i + 128]
            spans = [self.codec.spans(SPACE + t.replace(" ", SPACE)) if t else [] for t in part]
            self._learn(set().union(*spans))
            for t, own in zip(part, spans, strict=True):
                out.append(self._of(t, b"".join(map(self.known.__getitem__, own))) if t else (0, None, None, None))
        return out

    def measure(self, text: str | None) -> tuple[int, float | None, float | None, float | None]:
        return self.measures([text])[0]

    def _of(self, text: str, raw: bytes) -> tuple[int, float, float, float]:
        ids = np.frombuffer(raw, "<u4")
        n = len(ids)
        counts = np.bincount(ids)
        counts = counts[counts > 0]
        # the entropy of counts c of n tokens is log n - sum(c log c) / n
        return n, len(text) / n, int(np.count_nonzero(self.fallback[ids])) / n, float(np.log2(n) - (counts * np.log2(counts)).sum() / n)


def fertility(path: str) -> Fertility:
    return loaded(("fertility", path), lambda: Fertility(path))


def band_of(text: str, language: str | None, bands: dict[str, Band]) -> Band:
    """The band of the text's language, or else of its script."""
    if language and language in bands:
        return bands[language]
    latin = 2 * len(_LATIN.findall(text)) >= len(_LETTER.findall(text))
    return bands.get("Latn" if latin else "", bands[""])


def verdicts(f: Fertility, texts: list[str | None], languages: list[str | None], bands: dict[str, Band]) -> Iterator[tuple[tuple, tuple, bool, bool]]:
    """(base counts, token measures, base_failed, kept) of each text."""
    for text, language, m in zip(texts, languages, f.measures(texts), strict=True):
        c = base_counts(text)
        failed = c[0] < MIN_WORDS or 100 * c[4] > MAX_REPEAT_PERCENT * c[0]
        n, chars, fallback, entropy = m
        good = n > 0 and band_of(text, language, bands).admits(n, chars, fallback, entropy)
        yield c, m, failed, not failed and good


def verdict(f: Fertility, text: str | None, language: str | None, bands: dict[str, Band]) -> tuple[tuple, tuple, bool, bool]:
    return next(verdicts(f, [text], [language], bands))


def measure(docs: DataFrame, key: str, text: str, lang: str, tokenizer: str, bands: dict[str, Band] | None = None) -> DataFrame:
    """Per document: key, the base counts, base_failed, n_tokens, the three measures and kept."""
    bands = bands or BANDS
    kind = docs.schema[key].dataType.simpleString()

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        f = fertility(tokenizer)
        base, tokens, failed, kept = [], [], [], []
        for c, m, bad, good in verdicts(f, b.column(1).to_pylist(), b.column(2).to_pylist(), bands):
            base.append(c)
            tokens.append(m)
            failed.append(bad)
            kept.append(good)
        longs = [pa.array(x, pa.int64()) for x in zip(*base, strict=True)]
        n, *measures = zip(*tokens, strict=True)
        return pa.RecordBatch.from_arrays([b.column(0), *longs, pa.array(failed), pa.array(n, pa.int64()), *(pa.array(x, pa.float64()) for x in measures), pa.array(kept)], [key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_tokens", "chars_per_token", "byte_share", "token_entropy", "kept"])

    return map_batches(docs.select(F.col(key), F.col(text), F.col(lang).cast("string").alias("__lang")), [key, text, "__lang"], batch, f"`{key}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_tokens long, chars_per_token double, byte_share double, token_entropy double, kept boolean", keeps=True)


def keep_documents(docs: DataFrame, text: str, lang: str, tokenizer: str, bands: dict[str, Band] | None = None) -> DataFrame:
    """The documents that the rules keep, all columns, in one pass and without a shuffle."""
    bands = bands or BANDS

    @F.arrow_udf("boolean")
    def kept(texts: pa.Array, languages: pa.Array) -> pa.Array:
        f = fertility(tokenizer)
        return pa.array([good for *_, good in verdicts(f, texts.to_pylist(), languages.to_pylist(), bands)], pa.bool_())

    tune(docs.sparkSession)
    return docs.where(kept(F.col(text), F.col(lang).cast("string")))
