"""Line dedup by exact set-similarity join.

A line is the set of its words (runs of anything but ASCII white space). Two lines match if
their Jaccard similarity is at least ``threshold``. A line is removed if it matches a line
before it in the order of (document id, line number), judged on the input; lines of fewer than
``least`` distinct words are left alone.

1. Rarity. Words are counted over all texts into a fixed number of buckets. The bucket's count,
   then the word's hash, give one total order of all words; the join is right for any total
   order, and the counts make it put rare words first.
2. Lines with equal sets form a class, first within a batch of texts, then over all; only the
   class's first line can stay. Sets so small that
   one word more or less already breaks the threshold match equal sets only, and end here.
3. Prefix filter: two matching sets share a word among the first |x| - ceil(t |x|) + 1 of the
   larger and the first |y| - ceil(2 t / (1 + t) |y|) + 1 of the smaller. Those words meet.
4. Length filter: |y| >= t |x|. Positional filter: words after the shared ones must suffice for
   the overlap. A parity sketch bounds the sets' difference from below and drops most of the rest.
5. What is left is verified on the full sets. A class needs one earlier match only, so each
   class first tries few candidates per shared word; a class that has more and no match yet
   tries all of them. No candidate is dropped unseen.

Classes and words move between tasks in packed blocks of many, one for each bucket of hashes,
so the engine neither copies nor sorts single words.

Cases: null or empty texts have no lines to remove and stay as they are. Rows with equal ids and
texts are one document, and lose the same lines. Null ids come first; ids that are not integers
are ordered by their hash. An empty table gives an empty result. Other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultframe.llm.common import FEW_ROWS, discard, map_batches, marked, marks_of, materialise, mix64, packed_texts, row_hash, sweep, text_parts, tune, unload, unpacked, utf8_buffers, wide, word_hashes

THRESHOLD = 0.8
LEAST_WORDS = 1
#: Lines of more words have a wider sketch, of 64 bits for each 64 words and rounded up to a power of two, 1024 bits at most.
LONG_LINE = 64
#: Buckets of the word counts: 4 MB on the driver and in each worker, whatever the corpus.
BUCKETS = 1 << 20
_CHUNK = 1 << 13
#: Counts from here on are one rank.
_MOST = (1 << 20) - 1
#: Candidates that a class tries per shared word before its first verification.
FIRST_TRIES = 4
#: Pairs compared at once.
PAIRS = 2_000_000
#: Bytes of texts whose classes are packed at once.
PACK_BYTES = 64 << 20

_U = np.uint64


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, line it is in; text, and number in the text, of each line) of a batch of texts."""
    hashes, starts = word_hashes(data, offsets)
    line_starts, text, number = lines_of(data, offsets)
    bounds = np.searchsorted(starts, np.concatenate([line_starts, [len(data) + 1]]))
    return hashes, np.repeat(np.arange(len(line_starts)), np.diff(bounds)), text, number


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, text number, number in the text) of each line; every text has one line at least.

    An empty text shares its first byte with the next line, which then holds the words.
    """
    breaks = np.flatnonzero(data == 10) + 1
    starts = np.concatenate([offsets[:-1], breaks])
    text = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks - 1, "right") - 1])
    order = np.lexsort((text, starts))
    starts, text = starts[order], text[order]
    number = np.arange(len(starts)) - np.searchsorted(text, text)
    return starts, text, number


def wide_words(size: int) -> int:
    """64-bit words in a long line's sketch: a power of two."""
    return min(16, 1 << max(0, (size - 1).bit_length() - 6))


#: wide_words of each size up to where it no longer grows.
_WIDE = np.array([wide_words(n) for n in range(1026)])


def prefix_length(size: np.ndarray, share: float) -> np.ndarray:
    return size - np.ceil(share * size - 1e-9).astype(np.int64) + 1


def least_joined(threshold: float) -> float:
    """The least size of a set that can match a larger one: n / (n + 1) is the threshold or more."""
    return threshold / (1 - threshold) - 1e-9 if threshold < 1 else float("inf")


def word_counts(docs: DataFrame, text: str) -> np.ndarray:
    """Counts of all words of all texts by bucket; BUCKETS numbers come to the driver, however many words there are.

    A task's count of a bucket stops at 65,535: beyond, words are frequent, and any order will do.
    """
    tune(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, data, offsets in text_parts(*utf8_buffers(b.column(0))):
                total += np.bincount((word_hashes(data, offsets)[0] & _U(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        least = np.minimum(total, 65_535).astype(np.uint16)
        for k in range(0, BUCKETS, _CHUNK):
            if least[k : k + _CHUNK].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([least[k : k + _CHUNK].tobytes()], pa.binary())], ["first", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(c, np.uint16).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(v, _MOST).astype(np.uint32).tobytes() for v in sums.values()], pa.binary())], ["first", "counts"])

    chunks = docs.select(text).mapInArrow(count, "first int, counts binary")
    rows = chunks.repartition(wide(docs.sparkSession), "first").mapInArrow(add, "first int, counts binary").collect()
    out = np.zeros(BUCKETS, np.uint32)
    for r in rows:
        out[r["first"] : r["first"] + _CHUNK] = np.frombuffer(r["counts"], np.uint32)
    return out


class LineSets:
    """Sorted word sets of the lines of a batch of texts: rarest words first."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, counts: np.ndarray):
        hashes, line, self.text, self.number = words_of(data, offsets)
        rarity = counts[(hashes & _U(BUCKETS - 1)).astype(np.int64)]
        key = line.astype(_U) << _U(44)
        key |= rarity.astype(_U) << _U(24)
        key |= hashes >> _U(40)
        order = np.argsort(key)
        k, h = key[order], hashes[order]
        if len(line) and (line[-1] >= 1 << 20 or ((k[1:] == k[:-1]) & (h[1:] != h[:-1])).any()):  # the short key does not tell
            order = np.lexsort((hashes, hashes >> _U(40), rarity, line))
            h = hashes[order]
        rarity, line = rarity[order], line[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
        self.hashes, self.rarity, line = h[keep], rarity[keep], line[keep]
        #: lines with words: their number among all lines, and where their words lie
        self.at = np.flatnonzero(np.diff(line, prepend=-1))
        self.line = line[self.at]
        self.size = np.diff(np.concatenate([self.at, [len(line)]]))

    def keys(self) -> np.ndarray:
        """A hash of each set, the same for equal sets."""
        return mix64(np.add.reduceat(mix64(self.hashes * _U(0xA24BAED4963EE407)), self.at) + self.size.astype(_U)) if len(self.at) else np.zeros(0, _U)

    def sketches(self) -> np.ndarray:
        """64 parity bits: bit i tells whether an odd number of words hash to it."""
        return np.bitwise_xor.reduceat(_U(1) << (self.hashes >> _U(58)), self.at) if len(self.at) else np.zeros(0, _U)

    def wide_sketches(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(64-bit words of each line's, all of them): more parity bits for long lines, none for others.

        By the hash's low bits, so that halves fold together by xor.
        """
        size = self.size[lines]
        n = np.where(size > LONG_LINE, _WIDE[np.minimum(size, len(_WIDE) - 1)], 0)
        at, own = np.cumsum(n) - n, np.flatnonzero(n)
        out = np.zeros(int(n.sum()), _U)
        if len(own):
            count = size[own]
            which = np.repeat(own, count)
            h = self.hashes[np.repeat(self.at[lines[own]] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
            np.bitwise_xor.at(out, at[which] + ((h >> _U(52)).astype(np.int64) & (n[which] - 1)), _U(1) << ((h >> _U(46)) & _U(63)))
        return n, out.view(np.int64)


class Ragged:
    """Rows of equally named 64-bit columns, some with lists; packed into bytes and back."""

    def __init__(self, columns: dict[str, np.ndarray], lists: dict[str, tuple[np.ndarray, np.ndarray]]):
        #: lists: name -> (length of each row's list, all values one after another)
        self.columns, self.lists = columns, lists
        self.ends = {k: np.concatenate([[0], np.cumsum(n)]) for k, (n, _) in lists.items()}

    def __len__(self) -> int:
        return len(next(iter(self.columns.values())))

    def take(self, at: np.ndarray) -> Ragged:
        lists = {}
        for name, (n, flat) in self.lists.items():
            first, own = self.ends[name][at], n[at]
            lists[name] = (own, flat[np.repeat(first - (np.cumsum(own) - own), own) + np.arange(own.sum())])
        return Ragged({k: v[at] for k, v in self.columns.items()}, lists)

    def pack(self, lo: int, hi: int) -> bytes:
        head, body = [hi - lo], [c[lo:hi] for c in self.columns.values()]
        for k, (n, flat) in self.lists.items():
            ends = self.ends[k]
            head.append(int(ends[hi] - ends[lo]))
            body += [n[lo:hi], flat[ends[lo] : ends[hi]]]
        flat = np.concatenate([x.view(np.int64) for x in body])
        # bytes of equal weight together: small numbers' zeros then compress away
        return np.array(head, np.int64).tobytes() + flat.view(np.uint8).reshape(-1, 8).T.tobytes()

    @staticmethod
    def unpack(blocks: list[bytes], columns: list[str], lists: list[str]) -> Ragged:
        parts: dict[str, list[np.ndarray]] = {k: [] for k in columns}
        own: dict[str, tuple[list, list]] = {k: ([], []) for k in lists}
        for block in blocks:
            x = np.frombuffer(block, np.int64, 1 + len(lists))
            m, at = int(x[0]), 0
            flat = np.ascontiguousarray(np.frombuffer(block, np.uint8, offset=x.nbytes).reshape(8, -1).T).view(np.int64).ravel()
            for k in columns:
                parts[k].append(flat[at : at + m])
                at += m
            for i, k in enumerate(lists):
                n = int(x[1 + i])
                own[k][0].append(flat[at : at + m])
                own[k][1].append(flat[at + m : at + m + n])
                at += m + n
        joined = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return Ragged({k: joined(v) for k, v in parts.items()}, {k: (joined(a), joined(b)) for k, (a, b) in own.items()})

    @staticmethod
    def concat(parts: list[Ragged]) -> Ragged:
        first = parts[0]
        return Ragged({k: np.concatenate([p.columns[k] for p in parts]) for k in first.columns}, {k: (np.concatenate([p.lists[k][0] for p in parts]), np.concatenate([p.lists[k][1] for p in parts])) for k in first.lists})

    def cut(self, bucket: np.ndarray) -> tuple[list[int], list[bytes]]:
        """(bucket, block) of rows that are in the order of their buckets."""
        at = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]).tolist() if len(bucket) else [0]
        return [int(bucket[a]) for a in at[:-1]], [self.pack(a, b) for a, b in zip(at, at[1:], strict=False)]

    def dealt(self, by: str, buckets: int) -> tuple[list[int], list[bytes]]:
        """(bucket, block) of each bucket of a column of hashes."""
        bucket = _bucket(self.columns[by], buckets)
        order = np.argsort(bucket, kind="stable")
        return self.take(order).cut(bucket[order])


CLASS, CLASS_LISTS = ["set", "id", "row", "line", "n", "size", "sketch"], ["prefix", "wide"]
POSTING, POSTING_LISTS = ["word", "set", "id", "line", "packed", "sketch"], ["wide"]


def merged_classes(classes: Ragged) -> Ragged:
    """One row for each set: its first line in the order of (id, row, line), and how many lines there are."""
    c = classes.columns
    order = np.lexsort((c["line"], c["row"], c["id"], c["set"]))
    sets = c["set"][order]
    head = np.flatnonzero(np.concatenate([[True], sets[1:] != sets[:-1]])) if len(sets) else np.zeros(0, np.int64)
    out = classes.take(order[head])
    out.columns["n"] = np.add.reduceat(c["n"][order], head) if len(head) else head
    return out


def postings(classes: Ragged, asks: np.ndarray, buckets: int, marks: np.ndarray | None = None) -> tuple[list[int], list[bytes]]:
    """(bucket, block) of rows for each prefix word of the classes that can be elsewhere. packed: size, position, and whether the class asks."""
    n, words = classes.lists["prefix"]
    keep = words != 0
    if marks is not None:
        keep &= marked(marks, words)
    keep = np.flatnonzero(keep)
    keep = keep[np.argsort(_bucket(words[keep], buckets), kind="stable")]
    owner, words = np.repeat(np.arange(len(n)), n)[keep], words[keep]
    pos = keep - (np.cumsum(n) - n)[owner]
    c = classes.columns
    packed = ((c["size"] << 32) | asks)[owner] | (pos << 1)
    wide_own = Ragged({}, {"wide": classes.lists["wide"]}).take(owner).lists
    return Ragged({"word": words, "set": c["set"][owner], "id": c["id"][owner], "line": c["line"][owner], "packed": packed, "sketch": c["sketch"][owner]}, wide_own).cut(_bucket(words, buckets))


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes.view(_U) % _U(buckets)).astype(np.int32)


def _blocks(pairs: tuple[list[int], list[bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int32()), pa.array(pairs[1], pa.binary())], ["bucket", "block"])


def _padded(b: pa.RecordBatch, fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    """The batch with nulls in the columns that it lacks."""
    have = dict(zip(b.schema.names, b.columns, strict=True))
    return pa.RecordBatch.from_arrays([have.get(k, pa.nulls(b.num_rows, kind)) for k, kind in fields], [k for k, _ in fields])


_LINES = [("bucket", pa.int32()), ("block", pa.binary()), ("row", pa.int64()), ("id", pa.int64()), ("line", pa.int64()), ("set", pa.int64()), ("n_lines", pa.int64())]


def _lines(docs: DataFrame, key: str, text: str, counts: Broadcast, threshold: float, least: int, buckets: int) -> DataFrame:
    """(bucket, block, row, id, line, set, n_lines, key): every line of enough words and every document has a row, and every bucket of a batch's classes a block.

    A class's prefix has its rarest words first; it is empty for sets that match equal ones only.
    """
    tune(docs.sparkSession)

    def classes_of(s: LineSets, own: np.ndarray, row: np.ndarray, ids: np.ndarray, number: np.ndarray, sets: np.ndarray) -> Ragged:
        size = s.size[own]
        order = np.lexsort((number, row, ids, sets))
        head = np.flatnonzero(np.concatenate([[True], np.diff(sets[order]) != 0]))
        first = order[head]
        take = np.where(size[first] >= least_joined(threshold), prefix_length(size[first], threshold), 0)
        at = np.repeat(s.at[own[first]], take) + np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
        # a word counted once in its bucket is in no other line
        words = np.where(s.rarity[at] > 1, s.hashes[at], _U(0)).view(np.int64)
        columns = {"set": sets[first], "id": ids[first], "row": row[first], "line": number[first], "n": np.diff(np.concatenate([head, [len(order)]])), "size": size[first], "sketch": s.sketches()[own][first].view(np.int64)}
        return Ragged(columns, {"prefix": (take, words), "wide": s.wide_sketches(own[first])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unload()
        held: list[Ragged] = []
        size, fields = 0, _LINES
        for b in batches:
            if not b.num_rows:
                continue
            fields = [*_LINES, ("key", b.schema.field(3).type)]
            rows, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            data, offsets = utf8_buffers(b.column(2))
            n_lines = np.diff(np.searchsorted(np.flatnonzero(data == 10), offsets)) + 1
            yield _padded(pa.RecordBatch.from_arrays([b.column(0), pa.array(n_lines), b.column(3)], ["row", "n_lines", "key"]), fields)
            for lo, part, bounds in text_parts(data, offsets):
                s = LineSets(part, bounds, counts.value)
                own = np.flatnonzero(s.size >= least)
                if not len(own):
                    continue
                text_no, number = s.text[s.line[own]] + lo, s.number[s.line[own]]
                longs = rows[text_no], ids[text_no], number, s.keys()[own].view(np.int64)
                held.append(classes_of(s, own, *longs))
                longs = [pa.array(x, pa.int64()) for x in longs]
                yield _padded(pa.RecordBatch.from_arrays(longs, ["row", "id", "line", "set"]), fields)
            size += len(data)
            if held and size >= PACK_BYTES:
                yield _padded(_blocks(merged_classes(Ragged.concat(held)).dealt("set", buckets)), fields)
                held, size = [], 0
        if held:
            yield _padded(_blocks(merged_classes(Ragged.concat(held)).dealt("set", buckets)), fields)

    source = docs.select(row_hash(key, text), _order(docs, key), F.col(text).alias("__text"), F.col(key).alias("__key"))
    return source.mapInArrow(run, f"bucket int, block binary, row long, id long, line long, set long, n_lines long, key {docs.schema[key].dataType.simpleString()}")


def _order(docs: DataFrame, key: str):
    whole = docs.schema[key].dataType.typeName() in ("byte", "short", "integer", "long")
    return F.coalesce(F.col(key).cast("long") if whole else F.xxhash64(key), F.lit(-(2**63))).alias("__id")


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], list]]:
    """(bucket, its blocks, what else the first row has) of rows that are sorted by bucket."""
    last, held, extra = None, [], []
    for b in batches:
        others = [b.column(i).to_pylist() for i in range(2, b.num_columns)]
        for i, (k, block) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            if k != last and held:
                yield last, held, extra
                held = []
            if not held:
                extra = [x[i] for x in others]
            last = k
            held.append(block)
    if held:
        yield last, held, extra


_CLASSES = [("bucket", pa.int32()), ("block", pa.binary()), ("set", pa.int64()), ("row", pa.int64()), ("id", pa.int64()), ("line", pa.int64()), ("n", pa.int64())]


def _classes(lines: DataFrame) -> DataFrame:
    """(bucket, block, set, row, id, line, n): the classes as rows, and as a block for each bucket of sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unload()
        for bucket, blocks, _ in _by_bucket(batches):
            c = merged_classes(Ragged.unpack(blocks, CLASS, CLASS_LISTS))
            yield _padded(pa.RecordBatch.from_arrays([pa.array(c.columns[k]) for k in ("set", "row", "id", "line", "n")], ["set", "row", "id", "line", "n"]), _CLASSES)
            yield _padded(_blocks(([bucket], [c.pack(0, len(c))])), _CLASSES)

    dealt = lines.where("block is not null").select("bucket", "block").repartition(wide(lines.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "bucket int, block binary, set long, row long, id long, line long, n long")


def _all_postings(classes: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block) of the postings of all classes, each of which asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unload()
        for _, blocks, _ in _by_bucket(batches):
            c = Ragged.unpack(blocks, CLASS, CLASS_LISTS)
            yield _blocks(postings(c, np.ones(len(c), np.int64), buckets))

    return classes.where("block is not null").select("bucket", "block").mapInArrow(run, "bucket int, block binary")


def wide_fits(cols: dict[str, np.ndarray], big: np.ndarray, small: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """May two lines differ in so few words? Short lines pass; long ones by their wide sketches, folded to one width."""
    fits = np.ones(len(big), bool)
    size = cols["size"]
    both = np.flatnonzero(np.minimum(size[big], size[small]) > LONG_LINE)
    if not len(both):
        return fits
    width = lambda n: _WIDE[np.minimum(n, len(_WIDE) - 1)]
    kb, ks = width(size[big[both]]), width(size[small[both]])
    for a, b in {*zip(kb.tolist(), ks.tolist(), strict=True)}:
        own = both[(kb == a) & (ks == b)]
        for lo in range(0, len(own), 100_000):
            part = own[lo : lo + 100_000]
            x = cols["pool"][cols["wide_at"][big[part]][:, None] + np.arange(a)]
            y = cols["pool"][cols["wide_at"][small[part]][:, None] + np.arange(b)]
            n = min(a, b)
            x, y = (np.bitwise_xor.reduce(z.reshape(len(part), -1, n), axis=1) for z in (x, y))
            fits[part] = spare[part] >= np.bitwise_count(x ^ y).sum(axis=1)
    return fits


def _candidates(blocks: DataFrame, threshold: float, tries: int | None) -> DataFrame:
    """(x, y, word) of blocks of postings: set y comes before set x and passes the filters; at most ``tries`` for each x and word.

    word: given if x has more candidates by it than were tried, else null.
    """
    spark = blocks.sparkSession
    alpha = 2 * threshold / (1 + threshold)

    def compare(run: np.ndarray, cols: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """run: number of each posting's word; postings of a word lie together in ascending size."""
        size = cols["size"]
        least = np.ceil(threshold * size - 1e-9).astype(np.int64)
        wide_key = run * (1 << 32) + size
        low = np.searchsorted(wide_key, run * (1 << 32) + least, "left")
        count = np.arange(len(size)) - low
        ends = np.cumsum(count)
        i = 0
        while i < len(size):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
            n = count[i:j]
            big = np.repeat(np.arange(i, j), n)
            small = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[big]
            i = j
            if not len(big):
                continue
            ok = cols["pos"][small] < prefix_length(size[small], alpha)
            big, small = big[ok], small[ok]
            total = size[big] + size[small]
            need = np.ceil(threshold / (1 + threshold) * total - 1e-9)
            ok = 1 + np.minimum(size[big] - cols["pos"][big], size[small] - cols["pos"][small]) - 1 >= need
            spare = total - 2 * need
            ok &= spare >= np.bitwise_count(cols["sketch"][big] ^ cols["sketch"][small])
            ok &= cols["set"][big] != cols["set"][small]
            big, small, spare = big[ok], small[ok], spare[ok]
            ok = wide_fits(cols, big, small, spare)
            big, small = big[ok], small[ok]
            before = (cols["id"][small] < cols["id"][big]) | ((cols["id"][small] == cols["id"][big]) & ((cols["line"][small] < cols["line"][big]) | ((cols["line"][small] == cols["line"][big]) & (cols["set"][small] < cols["set"][big]))))
            yield np.where(before, big, small), np.where(before, small, big)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unload()
        for _, blocks, _ in _by_bucket(batches):
            found = Ragged.unpack(blocks, POSTING, POSTING_LISTS)
            n, pool = found.lists["wide"]
            order = np.lexsort((found.columns["packed"], found.columns["word"]))
            cols = {k: v[order] for k, v in found.columns.items()}
            packed = cols.pop("packed").view(_U)
            cols["size"], cols["pos"], cols["asks"] = (x.astype(np.int64) for x in (packed >> _U(32), (packed >> _U(1)) & _U(0x7FFFFFFF), packed & _U(1)))
            cols["sketch"], cols["pool"], cols["wide_at"] = cols["sketch"].view(_U), pool.view(_U), (np.cumsum(n) - n)[order]
            run = np.cumsum(np.concatenate([[0], np.diff(cols["word"]) != 0]))
            tried = np.zeros(len(run), np.int64)
            for x, y in compare(run, cols):
                asks = cols["asks"][x] > 0
                x, y = x[asks], y[asks]
                if tries is not None and len(x):
                    order = np.lexsort((cols["line"][y], cols["id"][y], x))  # the earliest candidates first
                    x, y = x[order], y[order]
                    rank = np.arange(len(x)) - np.searchsorted(x, x) + tried[x]
                    np.add.at(tried, x, 1)
                    more = rank == tries
                    keep = rank <= tries
                    x, y, more = x[keep], y[keep], more[keep]
                else:
                    more = np.zeros(len(x), bool)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(cols["set"][x]), pa.array(cols["set"][y]), pa.array(cols["word"][x], mask=~more)], ["x", "y", "word"])

    dealt = blocks.repartition(wide(spark), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(search, "x long, y long, word long")


def _asked_postings(classes: DataFrame, open_sets: DataFrame, n_open: int, buckets: int) -> DataFrame:
    """(bucket, block) of the postings that open_sets (set, word) have to meet: those of the words whose candidates were not all tried, taken out before any shuffle.

    Up to FEW_ROWS open sets are broadcast; more are joined with the blocks of their buckets.
    """
    context = open_sets.sparkSession.sparkContext
    both = classes.where("block is not null").select("bucket", "block")
    few = context.broadcast(open_sets.select("set").distinct().toArrow().column("set").to_numpy()) if n_open <= FEW_ROWS else None
    if few is None:
        asked = open_sets.groupBy(F.pmod(F.conv(F.hex("set"), 16, 10).cast("decimal(20,0)"), F.lit(buckets)).cast("int").alias("bucket")).agg(F.collect_set("set").alias("asked"))
        both = materialise(both.join(asked.hint("merge"), "bucket", "left").select("bucket", "block", F.coalesce("asked", F.array().cast("array<bigint>")).alias("asked")), "line-asked")

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Ragged, np.ndarray]]:
        unload()
        for _, blocks, sets in _by_bucket(batches):
            c = Ragged.unpack(blocks, CLASS, CLASS_LISTS)
            yield c, np.isin(c.columns["set"], few.value if few else sets[0])

    marks = context.broadcast(marks_of(open_sets, "word"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, asks in asking(batches):
            yield _blocks(postings(c, asks.astype(np.int64), buckets, marks.value))

    return both.mapInArrow(run, "bucket int, block binary")


def matched_sets(classes: DataFrame, docs: DataFrame, key: str, text: str, threshold: float, buckets: int) -> DataFrame:
    """(set) of the classes with a match before them."""
    firsts = classes.where("set is not null").select("set", "row", "line")

    def verified(pairs: DataFrame) -> DataFrame:
        """(set) of the pairs' x with a y that matches it."""
        wanted = pairs.select(F.explode(F.array("x", "y")).alias("set")).distinct()
        at = materialise(firsts.join(wanted, "set").select("row", F.struct("line", "set").alias("w")).groupBy("row").agg(F.collect_list("w").alias("wanted")), "line-wanted")

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            ids, words = [], []
            for raw_text, items in zip(unpacked(b.column(0)), b.column(1).to_pylist(), strict=True):
                lines = raw_text.split(b"\n")
                raw = [lines[w["line"]] for w in items]
                bounds = np.concatenate([[0], np.cumsum([len(x) + 1 for x in raw])])
                hashes, starts = word_hashes(np.frombuffer(b"\n".join([*raw, b""]), np.uint8), bounds)
                cut = np.searchsorted(starts, bounds)
                ids += [w["set"] for w in items]
                words += [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(cut, cut[1:], strict=False)]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.list_(pa.int64()))], ["set", "words"])

        texts = packed_texts(docs, row_hash(key, text), text, at)
        sets = materialise(map_batches(texts.join(at.hint("merge"), "row"), ["packed", "wanted"], batch, "set long, words array<long>").dropDuplicates(["set"]), "line-words")
        both = pairs.join(sets.select(F.col("set").alias("x"), F.col("words").alias("xw")), "x").join(sets.select(F.col("set").alias("y"), F.col("words").alias("yw")), "y")
        shared = F.size(F.array_intersect("xw", "yw"))
        return both.where(shared >= F.ceil((F.size("xw") + F.size("yw")) * F.lit(threshold / (1 + threshold)) - F.lit(1e-9))).select(F.col("x").alias("set")).distinct()

    tried = materialise(_candidates(_all_postings(classes, buckets), threshold, FIRST_TRIES), "line-candidates")
    sweep(docs.sparkSession)
    matched = materialise(verified(tried.select("x", "y").distinct()), "line-matched")
    open_sets = tried.where("word is not null").select(F.col("x").alias("set"), "word").join(matched, "set", "left_anti")
    open_sets = materialise(open_sets, "line-open")
    n_open = open_sets.count()
    if n_open:
        all_pairs = materialise(_candidates(_asked_postings(classes, open_sets, n_open, buckets), threshold, None), "line-candidates-all")
        matched = matched.unionByName(materialise(verified(all_pairs.select("x", "y").distinct()), "line-matched-all"))
    return matched


def removed_lines(docs: DataFrame, key: str, text: str, threshold: float = THRESHOLD, least: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """(row, line) of every line that matches a line before it, and (row, key, n_lines) of every document."""
    buckets = 2 * wide(docs.sparkSession)
    counts = docs.sparkSession.sparkContext.broadcast(word_counts(docs, text))
    lines = materialise(_lines(docs, key, text, counts, threshold, least, buckets), "lines")
    classes = materialise(_classes(lines), "line-classes")
    sweep(docs.sparkSession)
    matched = matched_sets(classes, docs, key, text, threshold, buckets)
    # classes with something to remove: the later lines, and the first one too if the class matched
    firsts = classes.where("set is not null").select("set", F.struct("row", "line").alias("first"), "n")
    hit = firsts.join(matched.withColumn("all", F.lit(True)), "set", "left").where("n > 1 or all").select("set", "first", F.coalesce("all", F.lit(False)).alias("all"))
    hit = materialise(hit, "line-hits")
    discard(classes)
    later = (F.col("row") != F.col("first.row")) | (F.col("line") != F.col("first.line"))
    gone = lines.where("set is not null").select("row", "line", "set").join(hit, "set").where(F.col("all") | later).select("row", "line").distinct()
    return gone, lines.where("n_lines is not null").select("row", "key", "n_lines")


def line_report(docs: DataFrame, key: str, text: str, threshold: float = THRESHOLD, least: int = LEAST_WORDS) -> DataFrame:
    """(key, n_lines, n_removed, removed_lines): per document; removed line numbers ascend from 0."""
    gone, scanned = removed_lines(docs, key, text, threshold, least)
    gone = gone.groupBy("row").agg(F.sort_array(F.collect_list("line")).alias("removed_lines"))
    return scanned.join(gone, "row", "left").select(F.col("key").alias(key), "n_lines", F.coalesce(F.size("removed_lines"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed_lines", F.array().cast("array<bigint>")).alias("removed_lines"))


def dedup_lines(docs: DataFrame, key: str, text: str, threshold: float = THRESHOLD, least: int = LEAST_WORDS) -> DataFrame:
    """``docs`` without the removed lines; a document that loses all its lines has an empty text."""
    gone = removed_lines(docs, key, text, threshold, least)[0].groupBy("row").agg(F.collect_list("line").alias("gone"))

    def flags(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for lines in b.column(1).to_pylist():
            own = np.zeros(max(lines) + 1, bool)
            own[lines] = True
            out.append(own)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.bool_()))], ["__row", "__gone"])

    gone = materialise(map_batches(gone, ["row", "gone"], flags, "__row long, __gone array<boolean>"), "lines-gone")
    kept = F.filter(F.zip_with(F.split(F.col(text), "\n", -1), F.col("__gone"), lambda t, g: F.when(~F.coalesce(g, F.lit(False)), t)), lambda t: t.isNotNull())
    # merged at every size, so that small and large inputs take the same way
    joined = docs.withColumn("__row", row_hash(key, text)).join(gone.hint("merge"), "__row", "left")
    return joined.withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).select(*docs.columns)
