"""Removal of long repeated byte strings by threshold-bounded interval expansion.

Every byte that lies in a string of ``length`` bytes which also starts anywhere else is
removed; strings never cross documents, overlaps count, and all is judged on the input. Several
lengths can be judged in one pass, over the pieces of the least of them.

1. Candidates. A rolling hash picks, in every window of ``length`` bytes, the 32-byte string of
   the least hash (its anchor), so equal windows have equal anchors at equal places. A run of
   windows with one anchor is cut by its offset from the anchor into pieces of up to GRID
   windows; windows of a piece have a core of ``length`` - GRID + 1 bytes in common. Pieces with
   one core are candidates for each other, and a piece whose core is nowhere else is unique.
2. Equal pieces are counted together, each distinct one once with its weight. A core with one
   distinct piece that is there twice or more has repeated windows only, and needs no bytes.
3. Interval expansion. Distinct pieces that share cores come together; their bytes, in blocks
   of eight aligned to the anchor, form a text with a Burrows-Wheeler transform. Breadth-first
   backward extension from the empty string yields the boundaries between suffixes in order of
   increasing common prefix; it stops at the threshold, and suffixes with no boundary between
   them share it. The bytes left and right of the whole blocks complete the windows' ``length``.
   A window whose string has a weight of two or more is repeated.
4. The repeated windows of a piece hold for each of its occurrences; their union is cut out.

A core is the unit of a task's work, not a document or a passage: pieces of a passage spread
over as many cores as it has anchors and grid cells.

Lengths are multiples of BLOCK. Pieces are told apart by core and content, two hashes of 64 bits:
two that differ are taken for one only if they share a core and their contents' hashes collide.

Cases: a null or empty text has no bytes and no spans; texts shorter than ``length`` stay
whole. Rows with equal ids are separate documents. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vaultframe.llm.common import discard, map_batches, materialise, packed_texts, power_tables, row_hash, sweep, tune, unload, unpacked, utf8_buffers, wide

LENGTH = 400
ANCHOR = 32
GRID = 128
BLOCK = 8
#: Bytes scanned at once; a longer text goes in parts that overlap by a window.
CHUNK = 1 << 19
#: Bytes of pieces whose transform is built at once.
INDEX_BYTES = 1 << 20

_U = np.uint64
_TABLE = (np.random.default_rng(20240517).integers(1, 2**63, 256, dtype=np.uint64) << _U(1)) | _U(1)
_SALT = _U(0x632BE59BD9B4E019)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(29))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(32)
    return h


def scan_pieces(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, longest: int | None = None) -> tuple[np.ndarray, ...]:
    """(document, core hash, content hash, first window, windows, lead, size) of all pieces of a batch of texts.

    first window is relative to the document; lead is the distance from it to the core. A piece's
    content has ``size`` bytes: it reaches ``longest`` bytes from its last window's start, as far as the document does.
    """
    span = length - ANCHOR + 1
    longest = longest or length
    out = []
    for at in range(0, max(len(data) - length + 1, 0), CHUNK):
        buf = data[at : at + CHUNK + longest - 1]
        n = len(buf)
        starts_n = min(CHUNK, n - length + 1)
        if starts_n <= 0:
            continue
        pw, ip = power_tables(n)
        prefix = np.zeros(n + 1, _U)
        np.cumsum(_TABLE[buf] * pw[:n], out=prefix[1:])
        m = n - ANCHOR + 1
        h = _mix((prefix[ANCHOR:] - prefix[:m]) * ip[:m])
        key = (h & _U(0xFFFFFFFF00000000)) | np.arange(m, dtype=_U)
        grid = np.full(-(-m // span) * span, _U(2**64 - 1))
        grid[:m] = key
        grid = grid.reshape(-1, span)
        before = np.minimum.accumulate(grid, axis=1).ravel()
        after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor_of = (np.minimum(after[:starts_n], before[span - 1 : span - 1 + starts_n]) & _U(0xFFFFFFFF)).astype(np.int64)
        lo = np.searchsorted(offsets, at, "right") - 1
        hi = np.searchsorted(offsets, at + starts_n, "left")
        sizes = np.minimum(offsets[lo + 1 : hi + 1], at + starts_n) - np.maximum(offsets[lo:hi], at)
        end_of = np.repeat(offsets[lo + 1 : hi + 1], sizes)
        s = np.flatnonzero(np.arange(at, at + starts_n) + length <= end_of)
        if not len(s):
            continue
        a = anchor_of[s]
        cell = (a - s) // GRID
        cut = np.flatnonzero((np.diff(s) != 1) | (np.diff(a) != 0) | (np.diff(cell) != 0)) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(s)]]) - 1
        sf, sl, af, q = s[first], s[last], a[first], cell[first]
        core_at = af - q * GRID
        core_end = core_at - GRID + 1 + length
        core = _mix((prefix[core_end] - prefix[core_at]) * ip[core_at] + (q + 1).astype(_U) * _SALT) ^ h[af]
        ends = np.minimum(sl + longest, end_of[sf] - at)
        content = _mix((prefix[ends] - prefix[sf]) * ip[sf] + (((sl - sf) * 4096 + core_at - sf) * 65536 + ends - sl).astype(_U) * _SALT)
        doc = np.searchsorted(offsets, sf + at, "right") - 1
        out.append((doc, core, content, sf + at - offsets[doc], sl - sf + 1, core_at - sf, ends - sf))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


# interval expansion


def _suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` symbols (by doubling)."""
    n = len(symbols)
    order = np.argsort(symbols)
    rank = np.empty(n, np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(symbols[order][1:] != symbols[order][:-1])])
    k = 1
    while k < depth and rank[order[-1]] < n - 1:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        k *= 2
    return order


def shared_prefix_classes(symbols: np.ndarray, *thresholds: int) -> list[np.ndarray]:
    """For each threshold and position, a number that two positions share exactly if so many symbols from there agree.

    Intervals of the Burrows-Wheeler transform are extended backwards, breadth first: those of
    strings of ``level`` symbols set the boundaries whose common prefix is ``level`` long.
    """
    n, threshold = len(symbols), max(thresholds)
    order = _suffix_order(symbols, threshold + 1)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = order - 1  # -1 wraps to the last symbol, a separator
    bwt, step = symbols[before], place[before]
    boundary = np.full(n + 1, -1, np.int64)
    boundary[0] = boundary[n] = 0
    heads = np.flatnonzero(np.diff(symbols[order])) + 1
    boundary[heads] = 0
    low, high = np.concatenate([[0], heads]), np.concatenate([heads, [n]]) - 1
    for level in range(1, threshold):
        one = low == high
        lows, highs = [step[low[one]]], [step[low[one]]]
        wl, wh = low[~one], high[~one]
        if len(wl):
            size = wh - wl + 1
            which = np.repeat(np.arange(len(wl)), size)
            k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + wl[which]
            by = np.lexsort((bwt[k], which))
            which, sym, to = which[by], bwt[k[by]], step[k[by]]
            head = np.flatnonzero(np.concatenate([[True], (np.diff(which) != 0) | (np.diff(sym) != 0)]))
            lows.append(np.minimum.reduceat(to, head))
            highs.append(np.maximum.reduceat(to, head))
        low, high = np.concatenate(lows), np.concatenate(highs)
        fresh = boundary[high + 1] < 0
        low, high = low[fresh], high[fresh]
        if not len(low):
            break
        boundary[high + 1] = level
    found = []
    for t in thresholds:
        out = np.empty(n, np.int64)
        out[order] = np.cumsum((boundary[:n] >= 0) & (boundary[:n] < t))
        found.append(out)
    return found


def repeated_windows(contents: list[bytes], windows: np.ndarray, leads: np.ndarray, weights: np.ndarray, lengths: tuple[int, ...] = (LENGTH,)) -> list[list[np.ndarray]]:
    """For each length and piece the flags of the piece's windows: is the window's string of that length repeated?

    weights: how often the whole piece occurs. Windows of different pieces are different places.
    """
    pad = (-leads) % BLOCK
    sizes = np.array([len(c) for c in contents])
    blocks = -(-(pad + sizes) // BLOCK) + 1  # and a separator
    at = np.concatenate([[0], np.cumsum(blocks)])
    raw = np.zeros(int(at[-1]) * BLOCK, np.uint8)
    for c, a, p in zip(contents, at, pad, strict=False):
        raw[a * BLOCK + p : a * BLOCK + p + len(c)] = np.frombuffer(c, np.uint8)
    values = raw.view(">u8").astype(_U)
    piece = np.repeat(np.arange(len(contents)), blocks)
    _, symbols = np.unique(values, return_inverse=True)
    symbols = symbols.astype(np.int64) + len(contents)
    ends = at[1:] - 1
    symbols[ends] = np.arange(len(contents))
    index = np.arange(len(values)) - at[piece]  # block number in the piece
    starts = np.flatnonzero(index * BLOCK - (BLOCK - 1) - pad[piece] < windows[piece])  # blocks that a window may begin in or before
    piece, index = piece[starts], index[starts]
    first_window, last_window, room = index * BLOCK - pad[piece], windows[piece], sizes[piece]
    previous = np.concatenate([[_U(0)], values[:-1]])[starts]
    flat_at = np.concatenate([[0], np.cumsum(windows)])
    found = []
    for length, classes in zip(lengths, shared_prefix_classes(symbols, *(n // BLOCK - 1 for n in lengths)), strict=True):
        whole = length // BLOCK - 1
        flat = np.zeros(int(flat_at[-1]), bool)
        following = np.concatenate([values[whole:], np.zeros(whole, _U)])[starts]
        classes = classes[starts]
        for part in range(BLOCK):  # bytes of the window before its first whole block
            window = first_window - part
            k = np.flatnonzero((window >= 0) & (window < last_window) & (window + length <= room))
            if not len(k):
                continue
            rest = following[k] if part == 0 else (previous[k] << _U(64 - 8 * part)) | (following[k] >> _U(8 * part))
            by = np.lexsort((rest, classes[k]))
            c, r = classes[k][by], rest[by]
            head = np.flatnonzero(np.concatenate([[True], (np.diff(c) != 0) | (r[1:] != r[:-1])]))
            total = np.add.reduceat(weights[piece[k[by]]], head)
            twice = np.repeat(total >= 2, np.diff(np.concatenate([head, [len(k)]])))
            hit = k[by][twice]
            flat[flat_at[piece[hit]] + window[hit]] = True
        found.append([flat[flat_at[i] : flat_at[i + 1]] for i in range(len(contents))])
    return found


def runs_of(flags: np.ndarray) -> list[int]:
    """Flat list first, last, first, last ... of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    edge[1::2] -= 1
    return edge.tolist()


def merged_spans(spans: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(starts, ends) of the maximal runs of the half-open spans (a, b) of each list; null lists have none."""
    bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    flat = spans.flatten()
    begin, end = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        order = np.argsort(begin[lo:hi])
        a, b = begin[lo:hi][order], np.maximum.accumulate(end[lo:hi][order])
        head = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]])) if hi > lo else order
        out.append((a[head], b[np.concatenate([head[1:], [hi - lo]]) - 1] if hi > lo else b))
    return out


def without_spans(text: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """What is left of the text beside its spans."""
    return b"".join([text[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(text)], strict=True)])


# the plan


def _scan(docs: DataFrame, key: str, text: str, length: int, longest: int) -> DataFrame:
    """(key, row, n_bytes, sha, pieces): row stands for the document's id and text."""
    kind = docs.schema[key].dataType.simpleString()

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = utf8_buffers(b.column(1))
        doc, core, content, first, windows, lead, size = scan_pieces(data, offsets, length, longest)
        order = np.argsort(doc, kind="stable")
        packed = (first << 30) | ((size - windows) << 20) | (windows << 10) | lead
        items = pa.StructArray.from_arrays([pa.array(x[order].astype(np.uint64).view(np.int64) if x.dtype == np.uint64 else x[order], pa.int64()) for x in (core, content, packed)], ["core", "content", "at"])
        bounds = np.searchsorted(doc[order], np.arange(b.num_rows + 1)).astype(np.int32)
        shas = [hashlib.sha256(data[s:e]).hexdigest() for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([b.column(2), b.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(shas), pa.ListArray.from_arrays(pa.array(bounds), items)], [key, "row", "n_bytes", "sha", "pieces"])

    return map_batches(docs.select(row_hash(key, text), F.col(text).alias("__text"), key), ["__row", "__text", key], batch, f"`{key}` {kind}, row long, n_bytes long, sha string, pieces array<struct<core:long,content:long,at:long>>")


def repeated_spans(docs: DataFrame, key: str, text: str, *lengths: int) -> tuple[DataFrame, DataFrame]:
    """(scanned, spans): scanned(key, row, n_bytes, sha), spans(row, spans, spans1 ...) of documents with any.

    spans: half-open byte ranges, an array of struct(a, b), of the strings of the first length;
    spans1 ... are those of the other lengths. The pieces are those of the least length, and
    reach as far as the greatest asks: equal strings of any of the lengths meet in one core.
    """
    if not lengths or any(n % BLOCK or not ANCHOR + GRID <= n <= 1024 for n in lengths):
        raise ValueError(f"lengths are multiples of {BLOCK} from {ANCHOR + GRID} to 1024")
    spark = docs.sparkSession
    tune(spark)
    longest = max(lengths)
    scanned = materialise(_scan(docs, key, text, min(lengths), longest), "suffix-scan")
    flat = scanned.select("row", F.explode("pieces").alias("p")).select("row", "p.core", "p.content", "p.at")
    distinct = flat.groupBy("core", "content").agg(F.count("*").alias("n"), F.first("row").alias("row"), F.first("at").alias("at"))  # both of one piece, whichever comes first
    core = W.partitionBy("core")
    shared = distinct.withColumns({"total": F.sum("n").over(core), "kinds": F.count("*").over(core)}).where("total > 1").select("core", "content", "n", "row", "at", (F.col("kinds") > 1).alias("several"))
    shared = materialise(shared, "suffix-shared")
    sweep(spark)
    by_doc = shared.where("several").groupBy("row").agg(F.collect_list(F.struct("core", "content", "at", "n")).alias("wanted"))
    texts = packed_texts(docs, row_hash(key, text), text)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns: list[list] = [[], [], [], [], []]
            for raw, items in zip(unpacked(b.column(0)), b.column(1).to_pylist(), strict=True):
                for w in items:
                    at = w["at"]
                    first, size = at >> 30, ((at >> 20) & 1023) + ((at >> 10) & 1023)
                    for c, v in zip(columns, (w["core"], w["content"], at & 0xFFFFF, w["n"], raw[first : first + size]), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())], ["core", "content", "shape", "n", "bytes"])

    located = texts.join(by_doc.hint("merge"), "row").select("packed", "wanted").mapInArrow(extract, "core long, content long, shape long, n long, bytes binary")
    dealt = located.repartition(wide(spark), "core").sortWithinPartitions("core", "content")

    runs = [f"runs{i or ''}" for i in range(len(lengths))]

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unload()
        held: list[tuple] = []
        size, last = 0, None

        def done() -> pa.RecordBatch:
            shape = np.array([h[2] for h in held])
            flags = repeated_windows([h[4] for h in held], shape >> 10, shape & 1023, np.array([h[3] for h in held]), lengths)
            found = [(*h[:2], *map(runs_of, f)) for h, *f in zip(held, *flags, strict=True) if any(x.any() for x in f)]
            held.clear()
            columns = list(zip(*found, strict=True)) or [[]] * (2 + len(lengths))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 2 else pa.list_(pa.int32())) for i, c in enumerate(columns)], ["core", "content", *runs])

        for b in batches:
            for item in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if item[:2] == last:  # a document that is there twice
                    continue
                if size >= INDEX_BYTES and item[0] != last[0]:
                    yield done()
                    size = 0
                last = item[:2]
                held.append(item)
                size += len(item[4])
        if held:
            yield done()

    schema = ", ".join(["core long", "content long", *(f"{r} array<int>" for r in runs)])
    repeated = materialise(dealt.mapInArrow(expand, schema), "suffix-repeated")
    # a core's only piece that is there twice or more: all its windows are, as far as its bytes reach
    windows, tail = (F.shiftright("at", k).bitwiseAND(F.lit(1023)) for k in (10, 20))
    whole = lambda n: F.least(windows - 1, windows + tail - n).cast("int")
    alone = shared.where("not several").select("core", "content", *(F.when(whole(n) >= 0, F.array(F.lit(0), whole(n))).otherwise(F.array().cast("array<int>")).alias(r) for r, n in zip(runs, lengths, strict=True)))
    sweep(spark)
    hits = flat.join(repeated.unionByName(alone), ["core", "content"]).select("row", F.shiftright("at", 30).alias("first"), *runs)

    def ranges(r: str, length: int):
        pair = lambda i: F.struct((F.col("first") + F.get(r, 2 * i)).cast("int").alias("a"), (F.col("first") + F.get(r, 2 * i + 1) + length).cast("int").alias("b"))
        return F.flatten(F.collect_list(F.when(F.size(r) > 0, F.transform(F.sequence(F.lit(0), (F.size(r) / 2 - 1).cast("int")), pair))))

    spans = hits.groupBy("row").agg(*(ranges(r, n).alias(f"spans{i or ''}") for i, (r, n) in enumerate(zip(runs, lengths, strict=True))))
    return scanned.select(key, "row", "n_bytes", "sha"), spans


def remove_repeats(docs: DataFrame, key: str, text: str, length: int = LENGTH) -> DataFrame:
    """``docs`` with ``text`` freed of repeats; bytes that no longer form UTF-8 become replacement marks."""
    scanned, spans = repeated_spans(docs, key, text, length)
    spans = materialise(spans, "suffix-spans").withColumnsRenamed({"row": "__row", "spans": "__spans"})
    discard(scanned)
    sweep(docs.sparkSession)

    @F.arrow_udf("string")
    def without(texts: pa.Array, rows: pa.Array) -> pa.Array:
        out = []
        for t, (a, b) in zip(texts.to_pylist(), merged_spans(rows), strict=True):
            out.append(without_spans((t or "").encode(), a, b).decode("utf-8", "replace") if len(a) else t)
        return pa.array(out, pa.string())

    joined = docs.withColumn("__row", row_hash(key, text)).join(spans.hint("merge"), "__row", "left")
    return joined.withColumn(text, without(text, "__spans")).select(*docs.columns)


def repeat_digest(docs: DataFrame, key: str, text: str, length: int = LENGTH, passage: int | None = None) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) per document.

    passage: a lesser length; ``n_passage`` then tells how many bytes lie in strings of that
    length which also start anywhere else. They are reported, not removed.
    """
    scanned, spans = repeated_spans(docs, key, text, length, *([passage] if passage else []))
    spans = materialise(spans if passage else spans.withColumn("spans1", F.lit(None).cast(spans.schema["spans"].dataType)), "suffix-spans")

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        removed, count, sha = [], [], []
        for raw, (starts, ends) in zip(unpacked(b.column(1)), merged_spans(b.column(2)), strict=True):
            removed.append(int((ends - starts).sum()))
            count.append(len(starts))
            sha.append(hashlib.sha256(without_spans(raw, starts, ends)).hexdigest())
        shared = [int((ends - starts).sum()) for starts, ends in merged_spans(b.column(3))]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha), pa.array(shared, pa.int64())], ["row", "n_removed", "n_spans", "left_sha", "n_passage"])

    texts = packed_texts(docs, row_hash(key, text), text, spans)
    cut = map_batches(texts.join(spans.hint("merge"), "row"), ["row", "packed", "spans", "spans1"], batch, "row long, n_removed long, n_spans long, left_sha string, n_passage long").dropDuplicates(["row"])
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_removed", "n_spans", "n_passage")]
    return scanned.join(cut, "row", "left").select(key, "n_bytes", *counts[:2], F.coalesce("left_sha", "sha").alias("kept_sha256"), *(counts[2:] if passage else []))
