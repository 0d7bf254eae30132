"""SentencePiece merge-type encoding by a prefix table, and decoding.

Every prefix of a text has one encoding, so one last token. The table holds that token for
each prefix, from left to right: an automaton over the vocabulary gives the tokens that end at
a position, and the one is taken that is compatible with the last token of the prefix before
it. Two tokens are compatible if the merges of their joined characters give back these two.
The ids are then read off backwards from the end.

A sequence is the merge result exactly if each pair of neighbours is: merges inside a token's
span are chosen best score first, leftmost first on equal scores, whatever stands around it.
No vocabulary piece holds the space mark after another character, a line feed, or a Latin
letter beside ASCII punctuation (checked on loading), so the text is cut there; each distinct
span is encoded once.

Cases: a null or empty text has no ids and decodes to an empty text. Characters outside the
vocabulary become byte ids. Repeated rows give equal results, other columns are kept, and
columns named like the results are replaced.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from vaultframe.llm.common import WordCache, loaded, map_batches

SPACE = "▁"
_MARK = r"!-/:-@\[-`{-~"
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"


class PieceCodec:
    """Encoder and decoder for one ``.model`` file of merge type with byte fallback."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = proto.ModelProto.SentencePiece
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not model.trainer_spec.byte_fallback:
            raise ValueError("only merge-type models with identity normalisation, a dummy prefix and byte fallback")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not handled")
        self.pieces = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.BYTE, self.CONTROL, self.UNKNOWN = kinds.BYTE, kinds.CONTROL, kinds.UNKNOWN
        self.unk_surface = model.trainer_spec.unk_surface
        self.id_of = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        crossing = re.compile(f"[{_MARK}][{_LETTER}]|[{_LETTER}][{_MARK}]|[^{SPACE}]{SPACE}|\n")
        if any(crossing.search(p) for p in self.score):
            raise ValueError("a piece reaches over a cut")
        self.automaton = ahocorasick.Automaton()
        for p in self.score:
            if len(p) > 1 and self.merges(p) == [p]:  # others are never a result
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.compatible = WordCache(lambda pair: self.merges(pair[0] + pair[1], len(pair[0])) is not None, 600_000)
        self.spans = re.compile(f"{SPACE}*(?:[^{SPACE}\n{_MARK}]*[{_LETTER}](?=[{_MARK}])|[^{SPACE}\n{_LETTER}]*[{_MARK}](?=[{_LETTER}])|[^{SPACE}\n]+)|\n|{SPACE}+").findall
        self.cache = WordCache(self.span)

    def merges(self, chars: str, wall: int = 0) -> list[str] | None:
        """The merge result of a short string; with a wall, None as soon as a merge reaches over it."""
        symbols = list(chars)
        score = self.score
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            if wall and sum(map(len, symbols[: at + 1])) == wall:
                return None
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def tokens(self, span: str) -> list[str]:
        """The prefix table of one span, read backwards."""
        n = len(span)
        last: list[str | None] = [None] * (n + 1)
        ending: list[list[str]] = [[c] for c in span]
        for end, piece in self.automaton.iter(span):
            ending[end].append(piece)
        compatible = self.compatible
        for end in range(n):
            for piece in ending[end]:
                start = end + 1 - len(piece)
                if start == 0 or (last[start] is not None and compatible[last[start], piece]):
                    last[end + 1] = piece
                    break
            else:
                raise AssertionError(f"no last token for {span[: end + 1]!r}")
        out = []
        while n:
            out.append(last[n])
            n -= len(last[n])
        return out[::-1]

    def ids(self, span: str) -> list[int]:
        out: list[int] = []
        for piece in self.tokens(span):
            i = self.id_of.get(piece)
            if i is not None:
                out.append(i)
            else:
                out += [self.byte_id[b] for b in piece.encode()]
        return out

    def span(self, span: str) -> tuple[int, str, str]:
        """(number of ids, ids joined by commas, their decoded text) of one span."""
        ids = self.ids(span)
        return len(ids), ",".join(map(str, ids)), self.surface(ids)

    def surface(self, ids: list[int]) -> str:
        """Decoded text without the removal of the dummy prefix."""
        out: list[str] = []
        run = bytearray()
        for i in ids:
            kind = self.kinds[i]
            if kind == self.BYTE:
                run.append(int(self.pieces[i][3:5], 16))
                continue
            if run:
                out.append(lenient(bytes(run)))
                run.clear()
            if kind == self.UNKNOWN:
                out.append(self.unk_surface)
            elif kind != self.CONTROL:
                out.append(self.pieces[i].replace(SPACE, " "))
        if run:
            out.append(lenient(bytes(run)))
        return "".join(out)

    def parts(self, text: str | None) -> list[tuple[int, str, str]]:
        if not text:
            return []
        return list(map(self.cache.__getitem__, self.spans(SPACE + text.replace(" ", SPACE))))

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for _, ids, _ in self.parts(text) for i in ids.split(",")]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the mark of the dummy prefix goes if the first visible piece has it."""
        text = self.surface(ids)
        first = next((i for i in ids if self.kinds[i] != self.CONTROL), None)
        return text[1:] if first is not None and self.kinds[first] not in (self.BYTE, self.UNKNOWN) and self.pieces[first][0] == SPACE else text


def lenient(raw: bytes) -> str:
    """UTF-8 text; each byte that is not part of a valid sequence becomes one replacement mark."""
    try:
        return raw.decode()
    except UnicodeDecodeError as e:
        return raw[: e.start].decode() + "�" + lenient(raw[e.start + 1 :])


def codec(path: str) -> PieceCodec:
    return loaded(("codec", path), lambda: PieceCodec(path))


def encode_documents(docs: DataFrame, text: str, path: str) -> DataFrame:
    """``docs`` with ids (array of int): the encoding of each whole text."""
    from pyspark.sql import functions as F

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        c = codec(path)
        return pa.array([c.encode(t) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return docs.withColumn("ids", ids(text))


def decode_documents(docs: DataFrame, ids: str, path: str) -> DataFrame:
    """``docs`` with decoded (string): the text of each array of ids; null for null."""
    from pyspark.sql import functions as F

    @F.arrow_udf("string")
    def decoded(rows: pa.Array) -> pa.Array:
        c = codec(path)
        return pa.array([None if r is None else c.decode(r) for r in rows.to_pylist()], pa.string())

    return docs.withColumn("decoded", decoded(ids))


def round_trip_digest(docs: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): each whole text encoded, and its ids decoded."""
    field = docs.schema[key]

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        n, ids, decoded = [], [], []
        for t in b.column(1).to_pylist():
            parts = c.parts(t)
            n.append(sum(p[0] for p in parts))
            ids.append(hashlib.sha256(",".join([p[1] for p in parts]).encode()).hexdigest())
            out = "".join([p[2] for p in parts])
            decoded.append(hashlib.sha256((out[1:] if out[:1] == " " else out).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs, [key, text], batch, f"`{key}` {field.dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string", keeps=True)
