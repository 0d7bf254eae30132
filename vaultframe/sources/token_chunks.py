"""Texts cut into chunks of a number of tokens that overlap, at good places, by a public vocabulary file.

A window holds most_tokens tokens and the next one begins overlap tokens before its end. A window
that doesn't end the text is cut behind the last paragraph, else sentence, else line end in its
last three tenths. Should such a cut lie before the next window's first token, the next window
begins at the cut, so that nothing is lost. Chunks are slices of the text, with their place in
characters and in UTF-8 bytes; tokens counts the tokens whose text begins in the chunk.

Null texts count as empty, and an empty text is one chunk without tokens.
"""

from __future__ import annotations

import bisect
import importlib.util
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_TOKENS, OVERLAP = 800, 120
#: Marks that end a sentence, and what a chunk may be cut behind, best first.
SENTENCE_ENDS = [". ", ".\n", "? ", "?\n", "! ", "!\n"]
TAIL_SHARE = 0.7
OUT_ROWS = 4096


def cut_after(piece: str) -> int | None:
    """Where to cut a piece, in its last three tenths; None if no place is good."""
    start = int(len(piece) * TAIL_SHARE)
    for marks in (["\n\n"], SENTENCE_ENDS, ["\n"]):
        found = [(k, len(m)) for m in marks if (k := piece.rfind(m, start)) >= 0]
        if found:
            k, size = max(found)
            return k + size
    return None


def spans(text: str, starts: list[int], most: int = MOST_TOKENS, overlap: int = OVERLAP) -> Iterator[tuple[int, int, int]]:
    """(start, end, tokens) in characters; starts: where each token begins."""
    total, at = len(starts), 0
    if total <= most:
        yield 0, len(text), total
        return
    while True:
        last = min(at + most, total)
        begin, end = 0 if at == 0 else starts[at], len(text) if last == total else starts[last]
        if last < total:
            cut = cut_after(text[begin:end])
            if cut:
                end = begin + cut
        held = bisect.bisect_left(starts, end)
        yield begin, end, held - at
        if last == total:
            return
        # tokens within one character begin at one place and stay together
        following = bisect.bisect_left(starts, starts[min(at + most - overlap, held)])
        at = following if following > at else bisect.bisect_right(starts, starts[at])


def _byte_level(vocabulary: str) -> bool:
    """Whether the file's tokens are the text's own bytes, split as ``TextEncoder`` knows it."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    unset = [spec.get(k) for k in ("normalizer", "post_processor", "truncation", "padding")] + [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix")]
    split = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    plain = not any(a["single_word"] or a["lstrip"] or a["rstrip"] or len(a["content"].split()) != 1 or a["content"] != a["content"].strip() for a in spec.get("added_tokens") or [])
    return bool(split and plain and model.get("type") == "BPE" and not any(unset))


def token_starts(vocabulary: str) -> Callable[[pa.Array], Iterator[list[int]]]:
    """A function from a column of texts to the characters where each text's tokens begin, as the library's offsets have them.

    Tokens of a byte-level file are bytes of the text, so that ids, which ``TextEncoder`` has by a table of pieces, tell where
    they begin. Other files, and texts whose ids are not all their bytes, are given to the library.
    """
    from tokenizers import Tokenizer

    def direct(texts: list[str | None]) -> Iterator[list[int]]:
        for t in texts:
            yield [s for s, _ in tokenizer.encode(t or "", add_special_tokens=False).offsets]

    if not (importlib.util.find_spec("vaultframe.llm") and _byte_level(vocabulary)):
        tokenizer = Tokenizer.from_file(vocabulary)
        return lambda column: direct(column.to_pylist())
    from vaultframe.llm.common import text_parts, utf8_buffers
    from vaultframe.llm.tokenizers_cached import encoder

    known = encoder(vocabulary, True)
    tokenizer = known.tokenizer
    sizes = np.zeros(len(known.edge), np.int64)
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        sizes[i] = len(token)  # a character of a token stands for a byte
    for i, token in tokenizer.get_added_tokens_decoder().items():
        sizes[i] = len(token.content.encode())

    def cached(column: pa.Array) -> Iterator[list[int]]:
        data, offsets = utf8_buffers(column)
        for first, part, bounds in text_parts(data, offsets):
            ids, of = known.encode(part, bounds)
            at = np.concatenate([[0], np.cumsum(sizes[ids])])
            if not np.array_equal(at[of], bounds):
                yield from direct(column.slice(first, len(bounds) - 1).to_pylist())
                continue
            place = np.cumsum((part & 0xC0) != 0x80) - 1
            for a, b, start in zip(of[:-1].tolist(), of[1:].tolist(), bounds[:-1].tolist(), strict=True):
                yield (place[at[a:b]] - place[start]).tolist() if a < b else []

    return cached


def chunks(docs: DataFrame, key: str, text: str, vocabulary: str, most: int = MOST_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """(key, seq, pos, byte_pos, tokens, chunk) of every text. vocabulary: a tokenizer file that all executors have."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts_of, rows, schema = token_starts(vocabulary), [], None

        def give() -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [schema, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()], strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, [key, "seq", "pos", "byte_pos", "tokens", "chunk"])

        for b in batches:
            schema = b.schema.field(0).type
            for k, t, starts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), starts_of(b.column(1)), strict=True):
                t = t or ""
                before, bytes_before = 0, 0
                for n, (s, e, tokens) in enumerate(spans(t, starts, most, overlap)):
                    # chunks overlap, so that a start may lie before the last one's end, never before its start
                    bytes_before += len(t[before:s].encode())
                    before = s
                    rows.append((k, n, s, bytes_before, tokens, t[s:e]))
                    if len(rows) >= OUT_ROWS:
                        yield give()
        if rows:
            yield give()

    return docs.select(key, F.col(text)).mapInArrow(run, f"{key} {kind}, seq int, pos long, byte_pos long, tokens long, chunk string")
