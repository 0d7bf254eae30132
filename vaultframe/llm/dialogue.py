"""Least-cost repair of conversations to alternating turns, by cost layers over grammar states.

A repaired conversation is empty, or an optional system turn and then pairs of user and assistant.
Edits: keep a turn (0), give it the role user or assistant (1), delete it (2), insert an empty turn
of user or assistant before any turn or at the end (5). Blank turns and turns whose role and text
came before must go; a turn that ends without a full stop, exclamation or question mark costs 5
more if it stays. Of the cheapest repairs the one whose letters (D, I, K, R) read least is taken.

States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. For a block of turns, layer
c holds for each turn a set of four bits: from which states can the rest be done at cost c at
most? A layer follows from the ones below it: keep, or cost 0, from the same layer one turn on,
other edits from the layer that their cost lies below. Layers are made for c = 0, 1, 2 ... until
the start is in one; that c is the cost, and the bits of the layers lead forward, least letter
first, to the audit. numpy does a layer's step for thousands of blocks at once.

No conversation is gathered for this, however long. Turns that must go change no state and cost
the same everywhere, so only the others take part. These are dealt by ranges of (conversation,
turn) into parts of a bounded number of rows, and parts are cut into blocks of BLOCK turns. Four
runs of layers tell what it costs to get through a block from each state to each other; such
tables are joined over the blocks of a part, and over the parts of a conversation by a fold that
reads one small table for each. So each part learns what its ends cost, and finds its edits for
each state it may be entered in. The last step reads a conversation's turns in order as a stream,
keeps a state and nothing else, and gives each edit with its text.

Cases: null role or text counts as one blank; null conversations are one conversation; turns go
nulls first, then in ascending order, ties by role, then by the text's first characters and its
digest. Equal turns of one conversation at one place are one row with a count: all but the first
are duplicates. Columns beyond the four are not carried. A conversation without turns must be named
by ``every`` to get a row. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultframe.llm.common import materialise, tune, wide

KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: What it costs to end in each state: insert what is lacking.
ENDS = np.array([0, 2 * INSERT, INSERT, 0])
#: Turns in a block; its layers hold (2 * BLOCK + 30) x BLOCK sets at most.
BLOCK = 32
#: Blocks whose layers are made at once.
BLOCKS_AT_ONCE = 2048
#: Turns in a part, of which a worker holds one at a time.
PART_ROWS = 1 << 17
#: Characters of a text that order ties.
HEAD = 64
WHITE = " \t\n\x0b\x0c\r"

S, U, A, OTHER, PAD = 0, 1, 2, 3, 8
#: The state after emitting u or a where that is what follows, or after s, by state; -1: not allowed.
AFTER = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
NEXT = np.array([2, 2, 3, 2])
LETTERS = "DKR"


def _before(after: np.ndarray) -> np.ndarray:
    """For each set of states, those from which ``after`` leads into it."""
    return np.array([sum(1 << g for g in range(4) if after[g] >= 0 and s >> after[g] & 1) for s in range(16)], np.uint8)


_KEPT = np.stack([_before(row) for row in AFTER])
_GIVEN = _before(NEXT)


class Layers:
    """Cost layers of many blocks. kinds: (turns, blocks), the role's symbol, 4 more if cut, or PAD.

    ends: (blocks, 4), what each state costs at the end of a block, at least 0. bits[c, i, b]: the
    states before turn i of block b from which the rest costs c at most.
    """

    def __init__(self, kinds: np.ndarray, ends: np.ndarray, wanted: int, most: int):
        turns, blocks = kinds.shape
        symbol, cut, pad = kinds & 3, kinds & 4 > 0, kinds == PAD
        self.kinds = kinds
        layers: list[np.ndarray] = []
        none = np.zeros((turns + 1, blocks), np.uint8)
        below = lambda c: layers[c] if c >= 0 else none
        self.cost = np.full((blocks, 4), -1, np.int64)
        powers = np.array([1, 2, 4, 8], np.uint8)
        for c in range(most + 1):
            now = np.empty((turns + 1, blocks), np.uint8)
            now[turns] = ((ends <= c) * powers).sum(axis=1)
            less, least, gone = below(c - REROLE), below(c - REROLE - CUT), below(c - DELETE)
            far, given = below(c - CUT), _GIVEN[below(c - INSERT)]
            # what does not depend on this layer, for all turns together
            rest = gone[1:] | given[:-1] | np.where(cut, _GIVEN[least[1:]] | _KEPT[symbol, far[1:]], _GIVEN[less[1:]])
            if c:
                rest |= layers[c - 1][:-1]
            rest[pad] = 0
            free = ~cut & ~pad
            for i in range(turns - 1, -1, -1):
                on = now[i + 1]
                now[i] = rest[i] | np.where(free[i], _KEPT[symbol[i], on], 0) | np.where(pad[i], on, 0)
            layers.append(now)
            fresh = (now[0][:, None] & powers > 0) & (self.cost < 0)
            self.cost[fresh] = c
            if (now[0] & wanted == wanted).all():
                break
        self.bits = np.stack(layers)

    def trace(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, states): for each turn 3 * inserts before it + letter, and the state at the end; least letters first."""
        turns, blocks = self.kinds.shape
        every = np.arange(blocks)
        state, cost = start.copy(), self.cost[every, start]
        codes = np.zeros((turns, blocks), np.uint8)

        def can(price: np.ndarray | int, at: int, to: np.ndarray) -> np.ndarray:
            left = cost - price
            return (left >= 0) & (to >= 0) & (self.bits[left.clip(0), at, every] >> to.clip(0) & 1 > 0)

        for i in range(turns):
            real = self.kinds[i] != PAD
            extra = np.where(self.kinds[i] & 4 > 0, CUT, 0)
            while True:
                drop = can(DELETE, i + 1, state)
                add = real & ~drop & can(INSERT, i, NEXT[state])
                if not add.any():
                    break
                codes[i][add] += 3
                cost = np.where(add, cost - INSERT, cost)
                state = np.where(add, NEXT[state], state)
            kept = AFTER[self.kinds[i] & 3, state]
            keep = ~drop & can(KEEP + extra, i + 1, kept)
            letter = np.where(drop, 0, np.where(keep, 1, 2))
            price = np.where(drop, DELETE, np.where(keep, KEEP + extra, REROLE + extra))
            after = np.where(drop, state, np.where(keep, kept, NEXT[state]))
            codes[i][real] += letter[real].astype(np.uint8)
            cost, state = np.where(real, cost - price, cost), np.where(real, after, state)
        return codes, state


def _dealt(kinds: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of blocks, their kinds as (turns, blocks)) in bounded lots of blocks of similar length."""
    order = np.argsort(sizes, kind="stable")
    for lo in range(0, len(order), BLOCKS_AT_ONCE):
        lot = order[lo : lo + BLOCKS_AT_ONCE]
        turns = int(sizes[lot].max(initial=0))
        place = np.arange(turns)[:, None]
        there = place < sizes[lot][None, :]
        yield lot, np.where(there, kinds[np.where(there, starts[lot][None, :] + place, 0)], PAD)


def passages(kinds: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(blocks, 4, 4): what it costs to get through each block from one state to another; FAR if it can't be done."""
    out = np.full((len(starts), 4, 4), FAR, np.int64)
    for lot, k in _dealt(kinds, starts, sizes):
        for end in range(4):
            ends = np.full((len(lot), 4), FAR)
            ends[:, end] = 0
            cost = Layers(k, ends, 16, 2 * k.shape[0] + 2 * INSERT + CUT).cost  # no set has a fifth bit: all layers are made
            out[lot, :, end] = np.where(cost < 0, FAR, cost)
    return out


#: More than any block can cost, and small enough to be added up.
FAR = 1 << 40


def through(table: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """What each state costs before a block or part, given what it costs behind it."""
    return (table + ends[None, :]).min(axis=1)


def joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return np.minimum((first[:, :, None] + second[None, :, :]).min(axis=1), FAR)


class Part:
    """A part's turns: kinds by row, and where each conversation's run begins."""

    def __init__(self, kinds: np.ndarray, cuts: np.ndarray):
        self.kinds, self.cuts = kinds, cuts
        sizes = np.diff([*cuts, len(kinds)])
        per = -(-sizes // BLOCK)
        self.run = np.repeat(np.arange(len(cuts)), per)
        self.first = np.concatenate([[0], np.cumsum(per)])
        self.starts = cuts[self.run] + BLOCK * (np.arange(len(self.run)) - self.first[self.run])
        self.sizes = np.minimum(np.append(cuts[1:], len(kinds))[self.run] - self.starts, BLOCK)

    def table(self, run: int) -> np.ndarray:
        own = slice(self.first[run], self.first[run + 1])
        tables = passages(self.kinds, self.starts[own], self.sizes[own])
        out = tables[0]
        for t in tables[1:]:
            out = joined(out, t)
        return out

    def codes(self, ends_of: dict[int, np.ndarray], entered: set[int]) -> np.ndarray:
        """(4, rows): codes for each state in which a run may be entered; only 0 counts for runs not in ``entered``.

        ends_of: what states cost at the end of a run that goes on elsewhere.
        """
        runs = len(self.cuts)
        last = self.first[1:] - 1
        ends = np.tile(ENDS, (len(self.starts), 1))
        for run, cost in ends_of.items():
            ends[last[run]] = cost
        several = np.flatnonzero(np.diff(self.first) > 1)
        inner = np.concatenate([np.arange(self.first[r], self.first[r + 1]) for r in several]) if len(several) else np.zeros(0, np.int64)
        tables = dict(zip(inner.tolist(), passages(self.kinds, self.starts[inner], self.sizes[inner]), strict=True))
        for r in several:
            for b in range(last[r], self.first[r], -1):
                ends[b - 1] = through(tables[b], ends[b])
        ends -= ends.min(axis=1, keepdims=True)
        open_runs = np.isin(np.arange(runs), [*entered, *several])
        many = open_runs[self.run]
        codes = np.zeros((4, len(self.kinds)), np.uint8)
        after = np.zeros((len(self.starts), 4), np.int64)
        for wanted, of in ((1, np.flatnonzero(~many)), (15, np.flatnonzero(many))):
            for lot, k in _dealt(self.kinds, self.starts[of], self.sizes[of]):
                blocks = of[lot]
                layers = Layers(k, ends[blocks], wanted, 2 * k.shape[0] + 6 * INSERT + CUT + int(ends[blocks].max(initial=0)))
                place = np.arange(k.shape[0])[:, None]
                there = place < self.sizes[blocks][None, :]
                at = (self.starts[blocks][None, :] + place)[there]
                for state in range(4 if wanted == 15 else 1):
                    found, after[blocks, state] = layers.trace(np.full(len(blocks), state))
                    codes[state, at] = found[there]
        # blocks of one run: the state in which a block is left is the one in which the next is entered
        for r in several:
            now = np.arange(4)
            for b in range(self.first[r], self.first[r + 1]):
                rows = slice(self.starts[b], self.starts[b] + self.sizes[b])
                codes[:, rows] = codes[now, rows]
                now = after[b, now]
        return codes


def run_starts(column: pa.Array) -> np.ndarray:
    """Where a column's runs of equal values begin; nulls are equal to each other."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) < 2:
        return np.zeros(min(1, len(column)), np.int64)
    a, b = column[1:], column[:-1]
    differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
    return np.concatenate([[0], np.flatnonzero(differ) + 1])


def _each_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of the rows of one part each; the first column is the part."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        cuts = [*run_starts(b.column(0)).tolist(), b.num_rows]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[-1].column(0)[0] != b.column(0)[s]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


PLACE = ["conv", "turn", "role", "head", "digest"]


def _ends(rows: DataFrame, conv_type: str) -> DataFrame:
    """(part, last, opens, e0..e3): what states cost at the end of a part's first and last run.

    The tables of all parts of a conversation meet as a stream, last part first.
    """
    tables = ", ".join(f"t{i} long" for i in range(16))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _each_part(batches):
            kinds, cuts = t.column("kind").to_numpy().astype(np.int64), run_starts(t.column("conv"))
            part = Part(kinds, cuts)
            runs = sorted({0, len(cuts) - 1})
            found = np.stack([part.table(r).reshape(-1) for r in runs])
            columns = [t.column("conv").combine_chunks().take(pa.array(cuts[runs])), pa.array([t.column("part")[0].as_py()] * len(runs), pa.int32()), pa.array([r == len(cuts) - 1 for r in runs]), *(pa.array(c, pa.int64()) for c in found.T)]
            yield pa.RecordBatch.from_arrays(columns, ["conv", "part", "last", *(f"t{i}" for i in range(16))])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the piece before, whose opening is known once the next one is seen
        ends, out = ENDS, []
        for b in batches:
            conv, part, last = (b.column(i).to_pylist() for i in range(3))
            table = np.stack([b.column(i + 3).to_numpy() for i in range(16)], axis=1).reshape(-1, 4, 4)
            for i in range(b.num_rows):
                if held is not None:
                    same = held[0] == conv[i]
                    out.append((held[1], held[2], not same, *held[3]))
                    if not same:
                        ends = ENDS
                held = conv[i], part[i], last[i], ends.tolist()
                ends = through(table[i], ends)
            if len(out) > 4096:
                yield _rows(out)
                out = []
        if held is not None:
            out.append((held[1], held[2], True, *held[3]))
        if out:
            yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.bool_(), pa.bool_(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["part", "last", "opens", "e0", "e1", "e2", "e3"])

    n = wide(rows.sparkSession)
    dealt = rows.select("part", *PLACE, "kind").repartition(n, "part").sortWithinPartitions("part", *PLACE)
    pieces = dealt.select("part", "conv", "kind").mapInArrow(measure, f"conv {conv_type}, part int, last boolean, {tables}")
    return pieces.repartition(n, "conv").sortWithinPartitions("conv", F.desc("part"), F.desc("last")).mapInArrow(fold, "part int, last boolean, opens boolean, e0 long, e1 long, e2 long, e3 long")


def decide(turns: DataFrame, written: list[DataFrame]) -> DataFrame:
    """Adds codes to turns(conv, turn, role, head, digest, kind), all of which may stay: one byte, or four by the state before."""
    conv_type = turns.schema["conv"].dataType.simpleString()
    n = max(wide(turns.sparkSession), -(-turns.count() // PART_ROWS))
    rows = materialise(turns.select(*PLACE, "kind").repartitionByRange(n, *PLACE).withColumn("part", F.spark_partition_id()), "dialogue-parts")
    written.append(rows)
    ends = _ends(rows, conv_type)
    blank = lambda df, names: df.select(*(F.col(c) if c in df.columns else F.lit(None).alias(c) for c in names))
    names = ["part", *PLACE, "kind", "last", "opens", "e0", "e1", "e2", "e3"]
    both = blank(ends, names).withColumn("tag", F.lit(0)).unionByName(blank(rows, names).withColumn("tag", F.lit(1)))
    dealt = both.repartition(n, "part").sortWithinPartitions("part", "tag", *PLACE)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _each_part(batches):
            told, t = t.filter(pc.equal(t.column("tag"), 0)).to_pylist(), t.filter(pc.equal(t.column("tag"), 1))
            if not t.num_rows:
                continue
            cuts = run_starts(t.column("conv"))
            part = Part(t.column("kind").to_numpy().astype(np.int64), cuts)
            at = lambda r: len(cuts) - 1 if r["last"] else 0
            codes = part.codes({at(r): np.array([r["e0"], r["e1"], r["e2"], r["e3"]]) for r in told}, {at(r) for r in told if not r["opens"]})
            four = np.zeros(len(cuts), bool)
            four[[at(r) for r in told if not r["opens"]]] = True
            wide_rows = np.repeat(four, np.diff([*cuts, t.num_rows]))
            packed = [codes[:, i].tobytes() if w else codes[:1, i].tobytes() for i, w in enumerate(wide_rows.tolist())]
            for b in t.select(["part", *PLACE]).append_column("codes", pa.array(packed, pa.binary())).to_batches(max_chunksize=16384):
                yield b

    return dealt.mapInArrow(choose, f"part int, conv {conv_type}, turn long, role string, head string, digest binary, codes binary")


def initial(role: str) -> int:
    return {"s": S, "u": U, "a": A}.get(role[:1], OTHER)


STEP = "step long, turn long, edit string, times long, fault string, role string, new_role string, text string, cost long"


def repair(conversations: DataFrame, conv: str, turn: str, role: str, text: str, copies: str | None = None, every: DataFrame | None = None, written: list[DataFrame] | None = None) -> DataFrame:
    """The edits of each conversation, one row each, rows of a conversation together and in order of step.

    (conv, step, turn, edit, times, fault, role, new_role, text, cost): edit D, I, K or R, done ``times`` times (deletes of
    copies); fault blank, duplicate or truncated; new_role and text as they are after the edit, null if deleted. The repaired
    conversation is the rows with a new_role. copies: a column that says how often a row stands at its place.
    every: (conv) that get a row, without edit and with step 0, whether or not they have turns.
    written: gets the tables that the result is read from; discard them once it is written.
    """
    spark, written = conversations.sparkSession, [] if written is None else written
    tune(spark)
    kept = conversations.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
        (F.col(copies).cast("long") if copies else F.lit(1).cast("long")).alias("copies"),
    )
    conv_type = kept.schema["conv"].dataType.simpleString()
    once = kept.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    rows = materialise(once.withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn("head", F.substring("text", 1, HEAD)), "dialogue-turns")
    end = F.substring(F.rtrim(F.col("text"), F.lit(WHITE)), -1, 1)
    small = rows.select(*PLACE, "copies", (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("cut"))
    # the first place of each role and text that has several in its conversation
    first = small.where(~F.col("blank")).groupBy("conv", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("there"), "turn")).alias("first"), F.count("*").alias("places")).where("places > 1")
    again = (F.col("s.conv").eqNullSafe(F.col("f.conv"))) & (F.col("s.role") == F.col("f.role")) & (F.col("s.digest") == F.col("f.digest"))
    late = F.col("f.places").isNotNull() & ~F.col("s.turn").eqNullSafe(F.col("f.first.turn"))
    fault = F.when(F.col("s.blank"), "blank").when(late, "duplicate").when(F.col("s.cut"), "truncated")
    flagged = materialise(small.alias("s").join(first.alias("f"), again, "left").select("s.*", fault.alias("fault")), "dialogue-faults")
    written += [rows, flagged]

    letter = F.substring("role", 1, 1)
    symbol = F.when(letter == "s", S).when(letter == "u", U).when(letter == "a", A).otherwise(OTHER)
    live = flagged.where("fault is null or fault = 'truncated'")
    decided = decide(live.select(*PLACE, (symbol + F.when(F.col("fault").isNotNull(), 4).otherwise(0)).cast("int").alias("kind")), written)

    names = ["conv", "header", "turn", "role", "head", "digest", "tag", "copies", "fault", "part", "codes", "text"]
    types = {"header": "boolean", "turn": "long", "role": "string", "head": "string", "digest": "binary", "copies": "long", "fault": "string", "part": "int", "codes": "binary", "text": "string"}
    level = lambda df, tag, header=False: df.withColumn("tag", F.lit(tag)).withColumn("header", F.lit(header)).select(*(F.col(c) if c in [*df.columns, "tag", "header"] else F.lit(None).cast(types[c]).alias(c) for c in names))
    parts = level(flagged.select(*PLACE, "copies", "fault"), 1).unionByName(level(decided, 2)).unionByName(level(rows.select(*PLACE, "text").where(end != ""), 3))
    if every is not None:
        parts = parts.unionByName(level(every.select(F.col(conv).cast(conv_type).alias("conv")).distinct(), 0, True))
    dealt = parts.repartition(wide(spark), "conv").sortWithinPartitions("conv", F.desc("header"), "turn", "role", "head", "digest", "tag")
    return dealt.select("conv", "tag", "turn", "role", "copies", "fault", "part", "codes", "text").mapInArrow(_edits, f"conv {conv_type}, {STEP}")


ROLES = {2: "user", 3: "assistant"}
#: Rows of an output batch, and bytes of text in one.
OUT_ROWS, OUT_BYTES = 8192, 8 << 20


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follows each conversation's codes with one state and gives its edits."""
    out: list[tuple] = []
    size = 0
    schema: pa.Schema | None = None
    now, began, state, variant, part, step = None, False, 0, 0, None, 0
    row: tuple | None = None
    wanted: tuple | None = None  # a kept turn that waits for its text

    def inserts(count: int) -> None:
        nonlocal state, step
        for _ in range(count):
            state = int(NEXT[state])
            step += 1
            out.append((now, step, None, "I", 1, None, None, ROLES[state], "", INSERT))

    def close() -> None:
        if began:
            inserts(int(ENDS[state]) // INSERT)

    def give() -> pa.RecordBatch:
        nonlocal size
        size = 0
        columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for b in batches:
        if schema is None:
            long, string = pa.int64(), pa.string()
            kinds = [b.schema.field(0).type, long, long, string, long, string, string, string, string, long]
            schema = pa.schema(list(zip(["conv", "step", "turn", "edit", "times", "fault", "role", "new_role", "text", "cost"], kinds, strict=True)))
        for conv, tag, turn, role, copies, fault, its_part, codes, text in zip(*(b.column(i).to_pylist() for i in range(9)), strict=True):
            if not began or conv != now:
                close()
                now, began, state, variant, part, step = conv, True, 0, 0, None, 0
            if tag == 0:
                out.append((conv, 0, None, None, 0, None, None, None, None, 0))
            elif tag == 1:
                row = turn, role, copies, fault
                wanted = None
                if fault in ("blank", "duplicate"):
                    step += 1
                    out.append((conv, step, turn, "D", copies, fault, role, None, None, DELETE * copies))
            elif tag == 2:
                turn, role, copies, fault = row
                if its_part != part:
                    part, variant = its_part, state
                count, letter = divmod(codes[variant] if len(codes) > 1 else codes[0], 3)
                inserts(count)
                step += 1
                extra = CUT if fault else 0
                if letter == 0:
                    out.append((conv, step, turn, "D", 1, fault, role, None, None, DELETE))
                elif letter == 1:
                    state = int(AFTER[initial(role), state])
                    wanted = (conv, step, turn, "K", 1, fault, role, role), KEEP + extra
                else:
                    state = int(NEXT[state])
                    wanted = (conv, step, turn, "R", 1, fault, role, ROLES[state]), REROLE + extra
                if letter == 0 and copies > 1:
                    step += 1
                    out.append((conv, step, turn, "D", copies - 1, "duplicate", role, None, None, DELETE * (copies - 1)))
            elif wanted is not None:
                out.append((*wanted[0], text, wanted[1]))
                size += len(text)
                wanted = None
                if row[2] > 1:
                    step += 1
                    out.append((conv, step, row[0], "D", row[2] - 1, "duplicate", row[1], None, None, DELETE * (row[2] - 1)))
            if len(out) >= OUT_ROWS or size >= OUT_BYTES:
                yield give()
    close()
    if out:
        yield give()


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def report(edits: DataFrame, arranged: bool = False) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for the edits of ``repair``.

    arranged: the rows come straight from ``repair``, so that those of a conversation lie together and in order.
    """
    if not arranged:
        edits = edits.repartition(wide(edits.sparkSession), "conv").sortWithinPartitions("conv", "step")
    conv_type = edits.schema["conv"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, now, out, kind = None, None, [], None

        def give() -> pa.RecordBatch:
            kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])

        for b in batches:
            kind = b.schema.field(0).type
            for conv, turn, edit, times, fault, role, new_role, text, cost in zip(*(b.column(i).to_pylist() for i in range(9)), strict=True):
                if tally is None or conv != now:
                    if tally is not None:
                        out.append((now, *tally.result()))
                    tally, now = Tally(), conv
                if edit is not None:
                    tally.add(turn, edit, times, fault, role, new_role, text, cost)
                if len(out) >= OUT_ROWS:
                    yield give()
        if tally is not None:
            out.append((now, *tally.result()))
        if out:
            yield give()

    wanted = edits.select("conv", "turn", "edit", "times", "fault", "role", "new_role", "text", "cost")
    return wanted.mapInArrow(read, f"conv {conv_type}, {REPORT}")


class Tally:
    """Counts of one conversation, from its edits in order."""

    def __init__(self):
        self.least = self.most = self.before = None
        self.turns = self.illegal = self.cost = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.audit: list[str] = []
        self.digest, self.lines = hashlib.sha256(), 0

    def add(self, turn, edit, times, fault, role, new_role, text, cost) -> None:
        self.cost += cost
        self.audit.append(edit * times)
        if fault:
            self.faults[fault] += times
        if edit != "I":
            if turn is not None:
                self.least = turn if self.least is None else self.least
                self.turns += turn != self.most
                self.most = turn
            letter = role[:1]
            self.illegal += (self.before is not None and self.before + letter not in ("su", "ua", "au")) + (times - 1)
            self.before = letter
        if new_role is not None:
            self.digest.update(f"{chr(10) if self.lines else ''}{new_role}:{text}".encode())
            self.lines += 1

    def result(self) -> tuple:
        gaps = 0 if self.least is None else min(self.most - self.least + 1 - self.turns, 2**63 - 1)
        return gaps, self.faults["blank"], self.faults["duplicate"], self.faults["truncated"], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


def damaged(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, copies): turns dropped, emptied, cut, repeated or given another role by crc32 of ``conv:turn``, modulo 20."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn).cast("string"), blank))
    rows = conversations.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), blank).alias("role"), F.coalesce(F.col(text), blank).alias("text"), (F.crc32(key) % 20).alias("kind"))
    return rows.where("kind <> 0").select(
        "conv",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )

