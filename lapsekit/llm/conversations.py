"""Repair of the turn structure of conversations: least-cost edits by a parallel Viterbi search.

A conversation's roles should read ``(s?(ua)+)?`` by their initials. Edits keep a row (0), give it the role the pattern
asks for (R, 2), delete it (D, 3), or insert an empty row of that role (I, 2); a row cut short that stays costs 1 more,
blank and duplicate rows must go. The audit is the initials of the cheapest edits, the ASCII-least of equally cheap ones.

The search knows four states: nothing yet, after s, after u, after a. ``V[state]`` is the least cost from a row to the end.
Rows lead from the vector behind them to the one before them, and only differences within a vector matter, so a
vector is a ``shape`` of least zero. Few shapes occur, and steps between them are looked up.

* **Chunks.** Rows are sorted by a range shuffle, a conversation of any length over many tasks, and cut into chunks of
  ``CHUNK`` rows. A conversation inside one chunk and not at its part's edge is done on the spot.
* **Rank convergence.** The other chunks start from the speculative vector of an end behind them. In fix-up passes a
  chunk takes the vector before the next chunk and reruns until its vectors differ from its last ones only by a
  constant: from there on nothing changes. Passes go on until every chunk has started from the right shape; pass k
  carries a vector through 4**k neighbouring chunks, so the passes number some log4 of the longest conversation.
* **Tracing.** With the stitched vectors each chunk is traced from every state it may be entered in. Its conversation
  then goes through the chunks in order, choosing traces and hashing the repaired text, which only runs in order.

Ties: rows of one turn go by role, then the first 64 characters of the text, then its MD5; equal rows are alike. Null
turns come first, a null conv_id is a conversation, other nulls are one space. A role without an initial s, u or a cannot be
kept. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapsekit.llm.shared import Work, read

#: Rows and characters of a chunk, at most (a longer text is one row).
CHUNK, CHUNK_CHARACTERS = 4096, 1_000_000
_SPACE = " \t\n\x0b\x0c\r"
_ENDS = tuple(".!?")
START, SYSTEM, USER, ASSISTANT = range(4)
_FAR = 1 << 40
#: The state after the role that the pattern asks for, that is to say after an insertion or a new role.
ASKED = (USER, USER, ASSISTANT, USER)
#: The state after a role that is kept, by its code.
KEPT = {0: {START: SYSTEM}, 1: {START: USER, SYSTEM: USER, ASSISTANT: USER}, 2: {USER: ASSISTANT}, 3: {}}
#: Codes of rows: 0 to 3 for s, u, a and others, CUT more for a row cut short; GONE for blank and duplicate rows.
CUT, GONE = 4, 8
BLANK, REPEATED = 8, 9

Shape = tuple[int, int, int, int]


def _with_insertions(costs: list[int]) -> list[int]:
    """Costs before any insertions made at a place, from those behind them."""
    once = [min(c, 2 + costs[ASKED[s]]) for s, c in enumerate(costs)]
    return [min(c, 2 + once[ASKED[s]]) for s, c in enumerate(once)]


#: Before the end of a conversation.
END: Shape = tuple(_with_insertions([0, _FAR, _FAR, 0]))


@lru_cache(maxsize=100_000)
def step(after: Shape, code: int) -> tuple[Shape, tuple[tuple[str, int, int], ...]]:
    """The shape before a row, and for each state the letters up to and with that of the row, the state then, the cost."""
    extra = int(CUT <= code < GONE)
    moves = []
    for s in range(4):
        options = [(3 + after[s], "D", s, 3)]
        if code < GONE:
            if s in KEPT[code % CUT]:
                options.append((extra + after[KEPT[code % CUT][s]], "K", KEPT[code % CUT][s], extra))
            options.append((2 + extra + after[ASKED[s]], "R", ASKED[s], 2 + extra))
        moves.append(min(options))
    costs = _with_insertions([m[0] for m in moves])
    least = min(costs)

    def trace(s: int) -> tuple[str, int, int]:
        total, letter, to, paid = moves[s]
        insertion = 2 + costs[ASKED[s]] == costs[s]
        if total == costs[s] and not (insertion and letter > "I"):
            return letter, to, paid
        letters, to, paid = trace(ASKED[s])
        return "I" + letters, to, paid + 2

    return tuple(c - least for c in costs), tuple(trace(s) for s in range(4))


def at_end(state: int) -> str:
    return "I" * (END[state] // 2)


def shapes(codes: bytes, after: Shape) -> Shape:
    """The shape before the first row."""
    for code in reversed(codes):
        after = step(after, code if code < GONE else GONE)[0]
    return after


def rerun(codes: bytes, after: Shape, last: Shape, before: Shape) -> Shape:
    """As ``shapes``, where the run from ``last`` gave ``before``; stops where both runs have one shape."""
    for code in reversed(codes):
        if after == last:
            return before
        code = min(code, GONE)
        after, last = step(after, code)[0], step(last, code)[0]
    return after


def traced(codes: bytes, after: Shape, final: bool, states: tuple[int, ...] = (0, 1, 2, 3)) -> list[tuple[str, int, int]]:
    """For each entry state: letters, the state at the end, the cost. ``final``: nothing follows."""
    moves = []
    for code in reversed(codes):
        after, found = step(after, min(code, GONE))
        moves.append(found)
    out = []
    for s in states:
        letters, paid = [], 0
        for found in reversed(moves):
            some, s, cost = found[s]
            letters.append(some)
            paid += cost
        if final:
            letters.append(at_end(s))
            paid += END[s]
        out.append(("".join(letters), s, paid))
    return out


def initial_code(role: str) -> int:
    return {"s": 0, "u": 1, "a": 2}.get(role[:1], 3)


def code_of(role: str, text: str) -> int:
    """A row's code as if it were the first with its role and text."""
    ends = text.rstrip(_SPACE)
    if not ends:
        return BLANK
    return initial_code(role) + (0 if ends.endswith(_ENDS) else CUT)


class Repair:
    """A conversation's result, from its chunks in order."""

    NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def __init__(self):
        self.state, self.audit, self.sha, self.lines = START, [], hashlib.sha256(), False
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.distinct = 0
        self.first = self.last = self.role = None

    def add(self, turns: list, roles: list, texts: list, codes: bytes, trace: tuple[str, int, int]) -> None:
        for turn, role in zip(turns, roles, strict=True):
            if turn is not None:
                if self.first is None:
                    self.first = turn
                self.distinct += turn != self.last
                self.last = turn
            if self.role is not None and self.role[:1] + role[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.role = role
        self.blank += codes.count(BLANK)
        self.duplicate += codes.count(REPEATED)
        self.truncated += sum(CUT <= c < GONE for c in codes)
        letters, _, paid = trace
        self.cost += paid
        self.audit.append(letters)
        at = 0
        for letter in letters:
            if letter == "I":
                self._emit("", "")
            elif letter == "D":
                at += 1
            else:
                self._emit(roles[at] if letter == "K" else "", texts[at])
                at += 1

    def _emit(self, role: str, text: str) -> None:
        if role:
            self.state = KEPT[initial_code(role)][self.state]
        else:
            self.state = ASKED[self.state]
            role = "user" if self.state == USER else "assistant"
        self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.lines = True

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
OPEN = "turns array<long>, roles array<string>, texts array<string>, codes binary, names array<binary>"
_RESULT = [pa.int64()] * 6 + [pa.string()] * 2
_OPEN = [pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.binary(), pa.list_(pa.binary())]


def _batch(rows: list[tuple], names: str, types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    each = [x.strip().split(" ")[0] for x in names.replace("array<", "").split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], each)


class _Chunks:
    """Rows of one part in order, gathered into chunks; and what becomes of them."""

    def __init__(self, part: int):
        self.part, self.seq, self.conversations, self.out = part, 0, 0, []
        self.began = False
        self._new()

    def _new(self) -> None:
        self.turns, self.roles, self.texts, self.names, self.size = [], [], [], [], 0

    def start(self, conv: int | None) -> None:
        self.conv, self.spilled, self.began = conv, False, True
        self.conversations += 1
        self._new()

    def add(self, turn: int | None, role: str, text: str) -> None:
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.names.append(hashlib.md5(f"{self.conv}\0{role}\0{text}".encode("utf-8", "surrogatepass")).digest())
        self.size += len(role) + len(text)
        if len(self.turns) >= CHUNK or self.size >= CHUNK_CHARACTERS:
            self._spill()

    def _codes(self) -> bytes:
        return bytes(code_of(r, t) for r, t in zip(self.roles, self.texts, strict=True))

    def _spill(self) -> None:
        rows = (self.turns, self.roles, self.texts, self._codes(), self.names)
        self.out.append((self.conv, self.part, self.seq, *[None] * 8, *rows))
        self.seq += 1
        self.spilled = True
        self._new()

    def end(self, last_of_part: bool) -> None:
        """Finishes a conversation that lies in one chunk inside the part; an edge may go on in another part."""
        if self.spilled or self.conversations == 1 or last_of_part:
            if self.turns or not self.spilled:
                self._spill()
            return
        codes, seen = bytearray(self._codes()), set()
        for k, (code, name) in enumerate(zip(codes, self.names, strict=True)):
            if code != BLANK and name in seen:
                codes[k] = REPEATED
            seen.add(name)
        repair = Repair()
        repair.add(self.turns, self.roles, self.texts, bytes(codes), traced(bytes(codes), END, True, (START,))[0])
        self.out.append((self.conv, self.part, None, *repair.row(), *[None] * 5))


CHUNKS = f"conv_id long, part int, seq long, {RESULT}, {OPEN}"
_CHUNKS = [pa.int64(), pa.int32(), pa.int64(), *_RESULT, *_OPEN]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, turn, role, text, lost) to finished conversations and open chunks."""
    chunks = _Chunks(TaskContext.get().partitionId())
    for batch in batches:
        for conv, turn, role, text, lost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not chunks.began or conv != chunks.conv:
                if chunks.began:
                    chunks.end(False)
                chunks.start(conv)
            if not lost:
                chunks.add(turn, role, text)
            if len(chunks.out) >= 500 or chunks.out and chunks.out[-1][2] is not None:
                yield _batch(chunks.out, CHUNKS, _CHUNKS)
                chunks.out = []
    if chunks.began:
        chunks.end(True)
    if chunks.out:
        yield _batch(chunks.out, CHUNKS, _CHUNKS)


def numbered(chunks: DataFrame) -> DataFrame:
    """Open chunks with ``idx``, their number over all parts, in order."""
    per = chunks.groupBy("part").agg(F.count("*").alias("n"))
    # one row for each part that has chunks
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return chunks.join(per, "part").withColumn("idx", F.col("base") + F.col("seq")).drop("base", "part", "seq")


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks (idx, more, codes, again) with duplicates in their codes, run from the speculative end behind them."""
    for batch in batches:
        rows = []
        for idx, more, codes, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            codes = bytearray(codes)
            for k in again or ():
                codes[k] = REPEATED if codes[k] != BLANK else BLANK
            rows.append((idx, more, bytes(codes), list(END), list(shapes(codes, END))))
        if rows:
            yield _batch(rows, VECTORS, _VECTORS)


VECTORS = "idx long, more boolean, codes binary, after array<int>, before array<int>"
_VECTORS = [pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())]


def _fixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks (group, idx, more, codes, after, before, next), last first in each group: each takes the shape before
    the chunk behind it, as just made in this task or, at the group's end, as the last pass left it."""
    group, have, at = None, None, None
    for batch in batches:
        rows = []
        for g, idx, more, codes, after, before, behind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            want = END if not more else tuple(have if g == group and at == idx + 1 else behind)
            found = rerun(codes, want, tuple(after), tuple(before))
            rows.append((idx, more, codes, list(want), list(found)))
            group, have, at = g, found, idx
        if rows:
            yield _batch(rows, VECTORS, _VECTORS)


def stitched(vectors: DataFrame, work: Work) -> DataFrame:
    """``vectors`` once every chunk has run from the shape before the next one."""
    k = 0
    while True:
        behind = vectors.select((F.col("idx") - 1).alias("idx"), F.col("before").alias("behind"))
        met = vectors.join(behind, "idx", "left")
        wrong = met.filter("more AND after != behind")
        if wrong.isEmpty():
            return vectors
        group = F.shiftright("idx", 2 * k).alias("group")
        met = met.select(group, "idx", "more", "codes", "after", "before", "behind")
        met = met.repartition("group").sortWithinPartitions("group", F.col("idx").desc())
        vectors = work.keep(met.mapInArrow(_fixed, VECTORS), f"vectors{k + 1}", free=False)
        k += 1


TRACES = "idx long, codes binary, letters array<string>, paid array<long>"
_TRACES = [pa.int64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())]


def _traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for idx, more, codes, after, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = traced(codes, tuple(after), not more)
            rows.append((idx, codes, [f[0] for f in found], [f[2] for f in found]))
        if rows:
            yield _batch(rows, TRACES, _TRACES)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks (conv_id, idx, turns, roles, texts, codes, letters, paid) in order to their conversations' results."""
    repair, conv = None, None
    for batch in batches:
        rows = []
        for k in range(batch.num_rows):  # texts of one chunk at a time
            c, _, turns, roles, texts, codes, letters, paid = (x[k].as_py() for x in batch.columns)
            if repair is None or c != conv:
                if repair:
                    rows.append((conv, *repair.row()))
                repair, conv = Repair(), c
            s = repair.state
            repair.add(turns, roles, texts, codes, (letters[s], 0, paid[s]))
        if rows:
            yield _batch(rows, f"conv_id long, {RESULT}", [pa.int64(), *_RESULT])
    if repair:
        yield _batch([(conv, *repair.row())], f"conv_id long, {RESULT}", [pa.int64(), *_RESULT])


def repaired(df: DataFrame, work: Work) -> DataFrame:
    """Per conv_id of ``df`` (conv_id, turn, role, text without nulls, and ``lost``, which takes a row out but not its
    conversation): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = df.select("conv_id", "turn", "role", "text", "lost", F.md5(F.col("text").cast("binary")).alias("name"))
    rows = rows.withColumns({"head": F.left("text", F.lit(64)), "salt": F.monotonically_increasing_id()})
    # the salt parts equal rows, which are alike
    order = ["conv_id", "turn", F.left("role", F.lit(64)), "head", "name", "salt"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = work.keep(placed.select("conv_id", "turn", "role", "text", "lost").mapInArrow(_chunks, CHUNKS), "chunks")
    done = found.filter("seq IS NULL").select("conv_id", *(x.split()[0] for x in RESULT.split(", ")))
    chunks = numbered(found.filter("seq IS NOT NULL").select("conv_id", "part", "seq", "turns", "roles", "texts", "codes", "names"))
    chunks = work.keep(chunks, "open", free=False)

    named = chunks.select("idx", F.posexplode("names").alias("at", "name"))
    first = named.groupBy("name").agg(F.min(F.struct("idx", "at")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = named.join(first, "name").filter(F.struct("idx", "at") > F.col("first"))
    again = again.groupBy("idx").agg(F.collect_list("at").alias("again"))  # CHUNK at most
    behind = chunks.select((F.col("idx") - 1).alias("idx"), F.col("conv_id").alias("next_conv"), F.lit(True).alias("any"))
    marked = chunks.select("idx", "conv_id", "codes").join(behind, "idx", "left").join(again, "idx", "left")
    more = F.col("any").isNotNull() & F.col("conv_id").eqNullSafe(F.col("next_conv"))
    vectors = work.keep(marked.select("idx", more.alias("more"), "codes", "again").mapInArrow(_marked, VECTORS), "vectors0", free=False)
    traces = work.keep(stitched(vectors, work).mapInArrow(_traces, TRACES), "traces", free=False)

    whole = chunks.select("conv_id", "idx", "turns", "roles", "texts").join(traces, "idx")
    whole = whole.repartition("conv_id").sortWithinPartitions("conv_id", "idx")
    names = ["conv_id", "idx", "turns", "roles", "texts", "codes", "letters", "paid"]
    return done.unionByName(whole.select(*names).mapInArrow(_joined, f"conv_id long, {RESULT}"))


def damaged(df: DataFrame) -> DataFrame:
    """The rows of ``df`` (conv_id, turn, role, text) with faults chosen by crc32 of conv_id and turn."""
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault: Column = F.crc32(F.concat(none("conv_id"), F.lit(":"), none("turn")).cast("binary")) % 20
    rows = df.select("conv_id", "turn", none("role").alias("role"), none("text").alias("text"), fault.alias("fault"))
    rows = rows.withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(F.col("fault") <= 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") == 0).alias("lost"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(read(spark, sf_dir, "conversations")), Work(spark, "op11"))
