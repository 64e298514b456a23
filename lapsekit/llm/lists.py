"""Links between members that share tokens: inverted lists, candidate pairs and components, without all pairs of a list.

The first rounds compare the members of each list with one pivot alone, another one in each round and only those not
yet in its component; this gathers large groups of near copies. The last round compares all pairs of a list that are
still in different components, so no link between two components is lost. Long lists are cut into a grid of parts, so that no task holds one whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsekit.llm.components import components
from lapsekit.llm.shared import Work

#: Members of a part of a list.
PART = 256
#: A list is heavy with more pairs left than this for each member.
HEAVY = 16
#: Rounds with one pivot a list at most; the later ones are for heavy lists. Fewer when the pairs left are no more than some
#: times the rows of all lists, or when a round links less than GAIN of its pairs. The last round is complete either way.
STARS, GAIN = 6, 0.1
#: Pairs judged at once in a task of the last round.
JUDGED = 20_000


def fits(x: Column, y: Column, least_ratio: float, place_x: Column, place_y: Column, overlap: float, kind: Column) -> Column:
    """Whether members of sizes ``x`` and ``y`` that meet at these places can be linked.

    Sizes must be within ``least_ratio``. Places count, from 0, the tokens of a member before the shared one in the order
    of all tokens (kind 0). A linked pair shares ``overlap`` of both sizes, so behind its first shared token enough
    must be left on both sides; the test holds in that list, whatever it says in others.
    """
    close = F.least(x, y) >= least_ratio * F.greatest(x, y) - 1e-9
    left = F.least(x - place_x, y - place_y) >= overlap * (x + y) - 1e-9
    return close & ((kind != 0) | left)


LISTS = "token long, member long, size int, kind int, place int, pivot long, pivot_size int, pivot_place int"


def shared_lists(tokens: DataFrame, work: Work, name: str = "lists") -> DataFrame:
    """``tokens``: token, member, and size, kind, place unless all are 1, 1, 0. Keeps tokens of two members or more, one row
    a member, and adds the list's ``pivot``, its least member, with its size and place. A list passes by in order; only its
    first row is held back."""
    sized = "size" in tokens.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: tuple | None = None  # first row of the list at hand
        last: tuple | None = None
        sent = False
        names = [x.split(" ")[0] for x in LISTS.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
        for batch in batches:
            if not batch.num_rows:
                continue
            token, member = (c.to_numpy() for c in batch.columns[:2])
            about = batch.column(2).to_numpy() if sized else np.full(len(token), (1 << 32) + (1 << 31))
            fresh = np.ones(len(token), bool)  # a member may come with its tokens more than once
            fresh[1:] = (token[1:] != token[:-1]) | (member[1:] != member[:-1])
            fresh[0] = last != (token[0], member[0])
            last = (token[-1], member[-1])
            if not fresh.any():
                continue
            token, member, about = token[fresh], member[fresh], about[fresh]
            size, kind, place = about >> 32, (about >> 31) & 1, about & ((1 << 31) - 1)
            n = len(token)
            new = np.ones(n, bool)
            new[1:] = token[1:] != token[:-1]
            new[0] = head is None or token[0] != head[0]
            first = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            carried = first < 0
            of = lambda column, k: np.where(carried, head[k] if head else 0, column[first])  # noqa: B023, E731
            pivot, pivot_size, pivot_place = of(member, 1), of(size, 2), of(place, 4)
            other = member != pivot
            starts = np.flatnonzero(new)
            bounds = np.concatenate([starts, [n]])
            several = np.logical_or.reduceat(other, starts) if len(starts) else np.zeros(0, bool)
            out = other.copy()
            out[starts[several]] = True  # a pivot goes with the first of its others
            rows = [tuple(c[out] for c in (token, member, size, kind, place, pivot, pivot_size, pivot_place))]
            if head is not None and not sent and other[: bounds[0] if len(starts) else n].any():
                rows.append(tuple(np.array([x]) for x in (*head, head[1], head[2], head[4])))
                sent = True
            if len(starts):
                at = int(starts[-1])
                head, sent = (token[at], member[at], size[at], kind[at], place[at]), bool(several[-1])
            columns = [np.concatenate(c) for c in zip(*rows, strict=True)]
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    # size, kind and place travel as one number
    about = F.shiftleft(F.col("size").cast("long"), 32) + F.shiftleft(F.col("kind").cast("long"), 31) + F.col("place") if sized else None
    placed = tokens.select("token", "member", *([about.alias("about")] if sized else []))
    placed = placed.repartition("token").sortWithinPartitions(*placed.columns)
    return work.keep(placed.mapInArrow(run, LISTS), name)


def _grid_pairs(lists: DataFrame, least_ratio: float, overlap: float, similar: Callable | None = None) -> DataFrame:
    """Pairs x < y of one list and different components. ``lists``: token, g, member, size, kind, place, comp.

    With ``similar`` rows carry what it compares, their member's ``text``, and only the pairs it accepts come out: what is
    compared stays inside the task. It takes the texts of some lists and gives what judges places of x and y among them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 3):
            judge = similar(table.column(9).to_pylist()) if similar else None
            token, i, j, part, member, size, kind, place, comp = (c.to_numpy() for c in table.select(range(9)).combine_chunks().columns)
            near = np.arange(len(token) - 1)  # rows whose group also holds the row ``step`` further on
            step, held, count = 1, [], 0
            waiting, many = [], 0  # pairs to judge, many at once: steps share their members
            while True:
                far = near + step
                same = (token[near] == token[far]) & (i[near] == i[far]) & (j[near] == j[far])
                near = near[same]
                if not len(near):
                    break
                far = near + step
                ok = (comp[near] != comp[far]) & (member[near] != member[far]) & ((part[near] != part[far]) | (i[near] == j[near]))
                ok &= np.minimum(size[near], size[far]) >= least_ratio * np.maximum(size[near], size[far]) - 1e-9
                left = np.minimum(size[near] - place[near], size[far] - place[far])
                ok &= (kind[near] != 0) | (left >= overlap * (size[near] + size[far]) - 1e-9)
                x, y = near[ok], far[ok]
                near = near[near + step + 1 < len(token)]
                step += 1
                if similar:
                    waiting.append((x, y))
                    many += len(x)
                    if many < JUDGED and len(near):
                        continue
                    x, y = judged(judge, waiting)
                    waiting, many = [], 0
                swap = member[x] > member[y]
                held.append((member[np.where(swap, y, x)], member[np.where(swap, x, y)]))
                count += len(x)
                if count > 100_000:
                    yield rows_of(held)
                    held, count = [], 0
            if many:
                x, y = judged(judge, waiting)
                swap = member[x] > member[y]
                held.append((member[np.where(swap, y, x)], member[np.where(swap, x, y)]))
                count += len(x)
            if count:
                yield rows_of(held)

    def judged(judge: Callable, waiting: list) -> tuple[np.ndarray, np.ndarray]:
        x, y = (np.concatenate(c) for c in zip(*waiting, strict=True))
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        alike = judge(x, y) if len(x) else np.zeros(0, bool)
        return x[alike], y[alike]

    def rows_of(held: list) -> pa.RecordBatch:
        columns = np.unique(np.concatenate([np.stack(c, axis=1) for c in held]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(columns[:, 0]), pa.array(columns[:, 1])], ["x", "y"])

    part = F.pmod(F.xxhash64("member"), F.col("g")).cast("int")
    rows = lists.withColumn("part", part).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    rows = rows.select(
        "token", F.least("part", "with").cast("int").alias("i"), F.greatest("part", "with").cast("int").alias("j"),
        "part", "member", "size", "kind", "place", "comp", *(["text"] if similar else []),
    )
    placed = rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    return placed.mapInArrow(run, "x long, y long")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Sorted rows in tables that end where the first ``keys`` columns change."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in range(keys)]
        if held and any(held[-1].column(k)[-1].as_py() != columns[k][0] for k in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = np.flatnonzero(change)
        cut = int(cuts[-1]) + 1 if len(cuts) else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def one_row_each(rows: DataFrame, work: Work, name: str) -> DataFrame:
    """``rows`` written, with one row of each ``node``. Rows do not move; only the keys of surplus ones do, and there are
    any only where the input repeats rows."""
    found = work.keep(rows.withColumn("row", F.monotonically_increasing_id()), name)
    several = found.groupBy("node").agg(F.min("row").alias("first"), F.count("*").alias("n")).filter("n > 1")
    surplus = found.select("node", "row").join(several, "node").filter("row != first").select("row")
    return found.join(work.keep(surplus, f"{name}-surplus", free=False), "row", "left_anti").drop("row")


def linked(
    lists: DataFrame,
    work: Work,
    verify: Callable[[DataFrame], DataFrame],
    least_ratio: float = 0.0,
    overlap: float = 0.0,
    texts: DataFrame | None = None,
    similar: Callable | None = None,
    exact: bool = True,
    cheap: int = 1,
) -> DataFrame:
    """Components (node, label) of members joined by verified pairs.

    ``verify`` takes pairs (x, y) and gives the linked ones. Pairs that ``fits`` rules out are not made. With ``texts``
    (node, text), short ones, and ``similar`` (of texts; what it gives takes places of x and y), the last round judges pairs
    where it finds them; unless it is ``exact``, those it accepts are verified. ``cheap``: pairs to judge there for each row of
    all lists that cost less than another round before.
    """
    columns = ["token", "member", "size", "kind", "place"]
    rows = lists.select(*columns, F.col("pivot").alias("p"), F.col("pivot_size").alias("np"), F.col("pivot_place").alias("pp"))
    total = lists.count()
    labels = None
    for k in range(STARS):
        possible = fits(F.col("size"), F.col("np"), least_ratio, F.col("place"), F.col("pp"), overlap, F.col("kind"))
        star = rows.filter("member != p").filter(possible)
        star = star.select(F.least("p", "member").alias("x"), F.greatest("p", "member").alias("y")).distinct()
        pairs = work.keep(star, f"pairs{k}", free=False)
        checked = work.keep(verify(pairs), f"verified{k}", free=False)
        labels = components(checked, work, f"components{k}", labels)
        placed = _placed(lists, labels, work, str(k))
        split = work.keep(_split(placed), f"split{k}", free=False)
        if k == 0:
            # later rounds are for the lists that would still give many pairs for each member
            heavy = work.keep(split.filter(F.col("left") > HEAVY * F.col("n")).select("token"), "heavy", free=False)
            whole, lists = lists, work.keep(lists.join(heavy, "token"), "heavy-lists", free=False)
            placed, split = placed.join(heavy, "token"), split.join(heavy, "token")
        left = split.agg(F.sum("left")).first()[0] or 0
        if left <= cheap * total or (k and checked.count() < GAIN * pairs.count()):
            break
        # The next pivot is of the list's largest component, picked by a hash; those outside meet it.
        rows = placed.join(_pivots(placed, str(k)), "token").filter("comp != pc").select(*columns, "p", "np", "pp")
    placed = _placed(whole, labels, work, "last")
    split = placed.groupBy("token").agg(F.count("*").alias("n"), F.min("comp").alias("least"), F.max("comp").alias("most"))
    split = split.filter("least != most").select("token", F.ceil(F.col("n") / PART).cast("int").alias("g"))
    placed = placed.join(split, "token")
    if similar:
        placed = placed.join(texts.withColumnRenamed("node", "member"), "member")
    pairs = work.keep(_grid_pairs(placed, least_ratio, overlap, similar).distinct(), "pairs")
    last = pairs if similar and exact else work.keep(verify(pairs), "verified")
    return components(last, work, labels=labels)


def _placed(lists: DataFrame, labels: DataFrame, work: Work, name: str) -> DataFrame:
    """List rows with their component."""
    columns = ["token", "member", "size", "kind", "place"]
    placed = lists.select(*columns).join(labels.withColumnRenamed("node", "member"), "member", "left")
    return work.keep(placed.select(*columns, F.coalesce("label", "member").alias("comp")), f"placed{name}", free=False)


def _split(placed: DataFrame) -> DataFrame:
    """Of each list that is still split, its members ``n`` and the pairs ``left`` to compare."""
    split = placed.groupBy("token", "comp").agg(F.count("*").alias("m")).groupBy("token").agg(
        F.sum("m").alias("n"),
        ((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))) / 2).alias("left"),
        F.count("*").alias("parts"),
    )
    return split.filter("parts > 1").drop("parts")


def _pivots(placed: DataFrame, name: str) -> DataFrame:
    """Of each list one member ``p`` of its largest component ``pc``, with its size and place."""
    pick = F.min(F.struct(F.xxhash64(F.lit(name), "member").alias("h"), "member", "size", "place")).alias("one")
    each = placed.groupBy("token", "comp").agg(F.count("*").alias("m"), pick)
    each = each.groupBy("token").agg(F.max(F.struct("m", "one.h", "one.member", "one.size", "one.place", "comp")).alias("one"))
    return each.select(
        "token", F.col("one.member").alias("p"), F.col("one.size").alias("np"), F.col("one.place").alias("pp"), F.col("one.comp").alias("pc")
    )
