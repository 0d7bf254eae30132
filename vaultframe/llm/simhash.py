"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has 64 bits: bit i is set if it is set in more than half of the XXH64
(seed 42) values of the text's word shingles, repeats counted. Words are runs of anything but
the six ASCII white-space characters, A-Z lower-cased; a text with fewer words than a shingle
is one shingle, a text without words has fingerprint zero.

Fingerprints that differ in at most ``distance`` bits are linked. They are cut into segments,
and a pair within the distance differs in few bits of at least one segment (the generalised
pigeonhole rule gives each segment its own radius). The table holds each distinct fingerprint
under its segment's value and, for a radius of two, under the values one flip away; a
fingerprint looks its segment's ball of radius one up in the table, so two flips meet half-way.
Everything found is verified by its complete distance. Within one table entry only a spanning
forest of the verified links is passed on, so the number of links stays below the number of
probes however many near copies meet. Components are the transitive closure.

Texts whose sets of shingles have a Jaccard similarity of 0.8 differ in some ten bits, too many
for such segments. With ``similarity``, texts are linked too if their sets are that similar:
min-hashes of the sets in BANDS bands of ROWS bring candidates together (a pair at 0.8 is missed
with a chance of 3 in 100,000, less above), the candidates' closure is dealt out, and every
link in it is verified on the complete sets.

Cases: null text counts as empty. All texts with one fingerprint are linked through it. Rows
with equal ids are separate texts of one document id. An empty table gives an empty result.
Other columns are not carried by ``fingerprints``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultframe.llm.common import connected_components, map_batches, materialise, mix64, tune, unload, wide

#: Bands of min-hashes, and min-hashes in a band.
BANDS, ROWS = 20, 4
#: Hash buckets that mark the candidates' texts: half a megabyte.
MARKS = 1 << 22

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None, words_in_shingle: int) -> np.ndarray:
    """XXH64 values of the text's word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.encode().translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    k = words_in_shingle
    if len(words) <= k:
        return np.array([xxh64_intdigest(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - k + 1
    return np.fromiter((xxh64_intdigest(line[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, n)


def fingerprint(text: str | None, words_in_shingle: int) -> int:
    """The text's fingerprint as an unsigned integer."""
    return _majority(shingles(text, words_in_shingle))


def _majority(h: np.ndarray) -> int:
    if not len(h):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):  # bits of at most 8192 shingles at once
        counts += np.unpackbits(h[i : i + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str, text: str, words_in_shingle: int = 5) -> DataFrame:
    """(key, fp): the fingerprint as a signed long."""
    kind = docs.schema[key].dataType.simpleString()

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, words_in_shingle) for t in b.column(1).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], [key, "fp"])

    return map_batches(docs, [key, text], batch, f"`{key}` {kind}, fp long")


def segments_for(distance: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of each segment: the fewest segments whose radii are two at most.

    With m segments, r = distance // m and a = distance - m * r, a pair within the distance is
    within r in one of the first a + 1 segments or within r - 1 in one of the others.
    """
    for m in range(1, 65):
        r, a = divmod(distance, m)
        radii = [r] * (a + 1) + [r - 1] * (m - a - 1)
        if max(radii) <= 2:
            cuts = [round(i * 64 / m) for i in range(m + 1)]
            return [(lo, hi - lo, radius) for lo, hi, radius in zip(cuts, cuts[1:], radii, strict=False) if radius >= 0]
    raise ValueError(f"distance {distance}")


def _links_of_entry(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the distinct fingerprints of one table entry.

    Breadth-first over the fingerprints not yet reached, so dense groups end after few steps
    and memory is linear.
    """
    links, rest = [], fps
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = np.bitwise_count(rest ^ at) <= distance
            if near.any():
                found = rest[near]
                links += [(int(at), int(f)) for f in found]
                front += list(found)
                rest = rest[~near]
    return links


def _bit(i: int):
    return F.lit(1 << i if i < 63 else -(1 << 63))


def _entries(values, segment: int):
    """Table entries of the values of one segment; nulls stand for no value."""
    return F.transform(F.filter(values, lambda v: v.isNotNull()), lambda v: F.xxhash64(F.lit(segment), v))


def links(distinct: DataFrame, distance: int) -> DataFrame:
    """(a, b) of signed fingerprints: every link of ``distinct(fp)`` is in the closure of these."""
    spark = distinct.sparkSession
    tune(spark)
    probes = []
    for number, (first, bits, radius) in enumerate(segments_for(distance)):
        value = F.col("fp") if bits == 64 else F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1))
        flips = [value] if radius == 0 else [value, *(value.bitwiseXOR(_bit(i)) for i in range(bits))]
        if radius == 1:
            # one of two values that differ in a bit has it clear: that one looks up the other
            flips = [value, *(F.when(value.bitwiseAND(_bit(i)) == 0, value.bitwiseOR(_bit(i))) for i in range(bits))]
        probes.append(_entries(F.array(*flips), number))
    entries = distinct.select("fp", F.explode(F.flatten(F.array(*probes))).alias("entry"))
    dealt = entries.repartition(wide(spark), "entry").sortWithinPartitions("entry")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unload()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def forest(entry: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero(np.diff(entry)) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(entry)]])
            found: list[tuple[int, int]] = []
            size = ends - starts
            two = starts[size == 2]  # most entries have one or two fingerprints
            near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance
            found += zip(fp[two[near]].tolist(), fp[two[near] + 1].tolist(), strict=True)
            for k in np.flatnonzero(size > 2):
                found += _links_of_entry(np.unique(fp[starts[k] : ends[k]]), distance)
            pairs = np.array(sorted({(min(p), max(p)) for p in found if p[0] != p[1]}), np.uint64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].view(np.int64) if len(pairs) else [], pa.int64()), pa.array(np.ascontiguousarray(pairs[:, 1]).view(np.int64) if len(pairs) else [], pa.int64())], ["a", "b"])

        for b in batches:
            entry, fp = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            if not len(entry):
                continue
            last = np.flatnonzero(entry != entry[-1])
            whole = last[-1] + 1 if len(last) else 0
            if whole:  # the last entry may go on in the next batch
                e, f = (np.concatenate(x) for x in zip(*held, (entry[:whole], fp[:whole]), strict=True))
                held = []
                yield forest(e, f)
            held.append((entry[whole:], fp[whole:]))
        if held:
            yield forest(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return dealt.select("entry", "fp").mapInArrow(verify, "a long, b long")


_ODD = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(h: np.ndarray) -> np.ndarray:
    """A hash of each band of the min-hashes of a set of shingles; none of an empty set."""
    if not len(h):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for i in range(0, len(h), 2048):
        least = np.minimum(least, (h[i : i + 2048, None] * _ODD).min(axis=0))
    rows = mix64(least).reshape(BANDS, ROWS) * _ODD[:ROWS]
    return mix64(rows.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def links_of_sets(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links among sorted distinct shingle sets, by their numbers; breadth-first as in _links_of_entry."""
    found: list[tuple[int, int]] = []
    size = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    open_ = np.ones(len(sets), bool)
    while open_.any():
        front = [int(np.argmax(open_))]
        open_[front[0]] = False
        while front and open_.any():
            at = front.pop()
            own = sets[at]
            place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            shared = np.bincount(owner[own[place] == flat], minlength=len(sets))
            near = np.flatnonzero(open_ & (shared >= similarity * (size + size[at] - shared) - 1e-9))
            found += [(at, int(k)) for k in near]
            front += near.tolist()
            open_[near] = False
        rest = open_[owner]  # what is linked is not compared again
        flat, owner = flat[rest], owner[rest]
    return found


def similar_links(docs: DataFrame, text: str, words_in_shingle: int, similarity: float) -> DataFrame:
    """(a, b) of signed fingerprints of texts whose shingle sets are similar: every such link that a band shows is in the closure of these."""
    spark = docs.sparkSession

    def bands(b: pa.RecordBatch) -> pa.RecordBatch:
        keys = [band_keys(shingles(t, words_in_shingle)) for t in b.column(1).to_pylist()]
        at = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(np.concatenate(keys), pa.int64())], ["t", "entry"])

    named = docs.select(F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("__text")).where("__text is not null")
    entries = materialise(map_batches(named, ["t", "__text"], bands, "t long, entry long"), "similar-entries")
    # each entry is a star around its least text: a superset of the candidates' closure, without their pairs
    heads = entries.groupBy("entry").agg(F.min("t").alias("head"), F.max("t").alias("last")).where("head <> last").select("entry", "head")
    stars = materialise(entries.join(heads, "entry").where("t <> head").select(F.col("t").alias("a"), F.col("head").alias("b")).distinct(), "similar-stars")
    groups = materialise(connected_components(stars, "similar-groups").distinct(), "similar-roots")
    rows = groups.select(F.col("node").bitwiseAND(F.lit(MARKS - 1)).cast("int").alias("k")).distinct().toArrow()
    flags = np.zeros(MARKS, bool)
    flags[rows.column("k").to_numpy()] = True
    shared = spark.sparkContext.broadcast(np.packbits(flags))

    def sets(b: pa.RecordBatch) -> pa.RecordBatch:
        """The texts that may be candidates; others are left out before anything is shuffled."""
        t = b.column(0).to_numpy(zero_copy_only=False)
        k = t & (MARKS - 1)
        own = b.take(pa.array(np.flatnonzero((shared.value[k >> 3] >> (7 - (k & 7))) & 1)))
        found = [shingles(x, words_in_shingle) for x in own.column(1).to_pylist()]
        fp = np.array([_majority(h) for h in found], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([own.column(0), pa.array(fp), pa.array([np.unique(h).tobytes() for h in found], pa.binary())], ["t", "fp", "shingles"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unload()

        def done(held: list[tuple[int, bytes]]) -> pa.RecordBatch:
            found = links_of_sets([np.frombuffer(x, np.uint64) for _, x in held], similarity)
            return pa.RecordBatch.from_arrays([pa.array([held[i][0] for i, _ in found], pa.int64()), pa.array([held[j][0] for _, j in found], pa.int64())], ["a", "b"])

        root, held = None, []
        for b in batches:
            for r, fp, x in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if r != root and held:
                    yield done(held)
                    held = []
                root = r
                held.append((fp, x))
        if held:
            yield done(held)

    own = map_batches(named, ["t", "__text"], sets, "t long, fp long, shingles binary").dropDuplicates(["t"])
    dealt = own.join(groups.select(F.col("node").alias("t"), "root"), "t").repartition(wide(spark), "root").sortWithinPartitions("root")
    return dealt.select("root", "fp", "shingles").mapInArrow(verify, "a long, b long").where("a <> b")


def components(docs: DataFrame, key: str, text: str, words_in_shingle: int = 5, distance: int = 4, similarity: float | None = None) -> DataFrame:
    """(key, fp, component_id): the least key that a document reaches over links, itself included."""
    marked = materialise(fingerprints(docs, key, text, words_in_shingle), "fingerprints")
    least = materialise(marked.groupBy("fp").agg(F.min(key).alias("least")), "distinct-fp")
    near = links(least.select("fp"), distance)
    if similarity is not None:
        near = near.union(similar_links(docs, text, words_in_shingle, similarity))
    found = materialise(near.distinct(), "simhash-links")
    roots = connected_components(found, "simhash-components").withColumnRenamed("node", "fp")
    linked = materialise(roots.join(least, "fp"), "simhash-roots")
    lowest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = least.join(linked.select("fp", "root").join(lowest, "root").select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return marked.join(by_fp, "fp").select(key, "fp", "component_id")


def keep_first(docs: DataFrame, key: str, text: str, words_in_shingle: int = 5, distance: int = 4, similarity: float | None = None) -> DataFrame:
    """The documents whose id is their component's id; of rows with equal ids all are kept."""
    dropped = components(docs, key, text, words_in_shingle, distance, similarity).where(F.col(key) != F.col("component_id")).select(key)
    return docs.join(dropped.distinct(), key, "left_anti").select(*docs.columns)
