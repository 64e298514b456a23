"""Jaccard join, repeated strings, line dedup and decontamination against plain versions."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lapsekit.llm import decontaminate, jaccard_join, lines, lists, substrings
from lapsekit.llm.components import components

WORDS = [f"w{i}" for i in range(400)]


def corpus(seed, n=60):
    """Texts with copies, near copies, shared passages, tiny texts, ties, repeats, nulls and a long one."""
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    passage, long = text(60), text(3000)
    out = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one"), (5, "one two"), (6, long), (7, long + " end")]
    base = text(90).split(" ")
    for i in range(10, 10 + n):
        kind = i % 6
        if kind == 0:
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            out.append((i, " ".join(words)))
        elif kind == 1:
            out.append((i, text(20) + " " + passage + "\n" + text(30)))
        elif kind == 2:
            out.append((i, rng.choice(out)[1]))
        elif kind == 3:
            short = (out[-1][1] or "a").split()[:9]
            out.append((i, " ".join([*short, rng.choice(WORDS)])))
        elif kind == 4:
            out.append((i, "x" * rng.randrange(500) + "é" * 60 + text(5)))
        else:
            out.append((i, text(rng.randrange(1, 14)) + "\n" + text(8)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join(docs, work, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_documents(docs(*rows), work).collect()}
    assert got == brute.components(rows)


@pytest.mark.parametrize("at_most", [0, 4, 8, 12])
def test_boundary_changes_no_link(docs, work, monkeypatch, at_most):
    rng = random.Random(at_most)
    base = [rng.choice(WORDS) for _ in range(18)]
    rows = [(i, " ".join([*base[: rng.randrange(1, 18)], *rng.sample(WORDS, rng.randrange(3))])) for i in range(80)]
    monkeypatch.setattr(jaccard_join, "boundary", lambda found: at_most)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_documents(docs(*rows), work).collect()}
    assert got == brute.components(rows)


def test_jaccard_join_of_nothing_and_of_repeated_rows(docs, work):
    assert jaccard_join.similar_documents(docs((1, "x")).filter("false"), work).count() == 0
    from lapsekit.llm.shared import Work

    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "q")]
    got = sorted((str(r.doc_id), r.component_id) for r in jaccard_join.similar_documents(docs(*rows), Work(work.spark, "x")).collect())
    assert got == [("1", 1), ("1", 1), ("2", 2), ("None", 1)]


def test_one_of_each(docs, work):
    rows = [(3, "a b c d e f g"), (1, "a b c d e f g"), (2, "other words"), (5, ""), (6, None)]
    left = jaccard_join.one_of_each(docs(*rows), work)
    assert sorted(r.doc_id for r in left.collect()) == [1, 2, 5, 6]
    assert left.columns == docs(*rows).columns


def test_rows_are_judged_one_by_one_where_ids_repeat(docs, work):
    near, other = "a b c d e f g", "some words that nothing else holds"
    rows = [(3, near), (1, near), (1, near), (None, near), (3, other), (None, "x y z"), (None, "x y z"), (7, ""), (7, None)]
    left = jaccard_join.one_of_each(docs(*rows), work)
    want = [(1, near), (3, other), (None, "x y z"), (7, ""), (7, None)]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in left.collect()))) == sorted(map(repr, want))
    assert left.columns == docs(*rows).columns


def test_clean_by_rows_where_ids_repeat(spark, docs, work):
    passage = " ".join(WORDS[:12])
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    rows = [(1, passage), (1, "clean words"), (None, "q " + passage), (None, "none"), (2, None)]
    left = decontaminate.clean(docs(*rows), items, work)
    assert sorted(map(repr, ((r.doc_id, r.text) for r in left.collect()))) == sorted(map(repr, [rows[1], rows[3], rows[4]]))


@pytest.mark.parametrize("seed", [3, 4])
def test_repeated_strings(docs, work, seed):
    rows = corpus(seed) + [(900, "ab" * 400), (901, "z" * 450), (902, "q" * 199), (903, "q" * 199), (904, None)]
    got = sorted(tuple(r) for r in substrings.remove_repeats(docs(*rows), work).collect())
    assert got == sorted(brute.repeated_bytes(rows))


def test_repeated_strings_in_parts_and_shards(docs, work, monkeypatch):
    rng = random.Random(8)
    text = lambda k: "".join(rng.choice("abcd ") for _ in range(k))
    shared = text(700)
    rows = [(i, text(300) + shared[rng.randrange(300) :] + text(100)) for i in range(8)] + [(50, text(9000) + shared + text(4000) + shared)]
    rows += [(51, rows[0][1]), (51, rows[0][1])]
    monkeypatch.setattr(substrings, "LARGE", 1)
    got = sorted(tuple(r) for r in substrings.remove_repeats(docs(*rows), work, part=1000).collect())
    assert got == sorted(brute.repeated_bytes(rows))


def test_repeated_strings_put_no_large_group_in_one_task(docs, work, monkeypatch):
    rng = random.Random(9)
    text = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    shared = text(420)
    rows = [(i, text(150 + i) + shared + text(150)) for i in range(40)]
    frame = type(docs((1, "x")))
    largest, plain = [], frame.sortWithinPartitions

    def spied(self, *cols, **options):
        keys = [c for c in cols if c in ("core", "shard")]
        if keys:  # each such group becomes one table of a task
            largest.append(self.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0)
        return plain(self, *cols, **options)

    monkeypatch.setattr(frame, "sortWithinPartitions", spied)
    monkeypatch.setattr(substrings, "LARGE", 10)
    got = sorted(tuple(r) for r in substrings.remove_repeats(docs(*rows), work).collect())
    assert got == sorted(brute.repeated_bytes(rows))
    assert largest and max(largest) <= 10


def test_runs_go_on_over_batches():
    rows = [(1, 1, 5), (1, 1, 6), (1, 1, 7), (1, 1, 9), (1, 2, 10), (2, 2, 11), (2, 2, 12)]
    for size in range(1, 8):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*x, strict=True)], ["doc", "th", "begin"]) for x in parts]
        got = [tuple(r.values()) for b in substrings.runs(iter(batches), 200) for r in b.to_pylist()]
        assert got == [(1, 1, 5, 207), (1, 1, 9, 209), (1, 2, 10, 210), (2, 2, 11, 212)]


def test_repeated_strings_of_nothing(docs, work):
    assert substrings.remove_repeats(docs((1, "x")).filter("false"), work).count() == 0


@pytest.mark.parametrize("seed", [5, 6])
def test_contamination(spark, docs, work, seed):
    rng = random.Random(seed)
    rows = corpus(seed)
    items = [(1, None), (2, ""), (3, "one two"), (4, "ONE!"), (5, " ".join(rng.choice(WORDS) for _ in range(9)))]
    items += [(i, " ".join((t or "").split()[5:45])) for i, t in rows if i % 5 == 1]
    rows += [(700 + i, f"pre {t} post" if t else t) for i, t in items] + [(990, "One, two; " * 30), (991, items[-1][1].upper())]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, w string")
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.contamination(docs(*rows), benchmark, work).collect()}
    want = brute.contamination(rows, items)
    assert got == want and any(x[-1] for x in want.values())
    from lapsekit.llm.shared import Work

    left = decontaminate.clean(docs(*rows), benchmark, Work(spark, "clean"))
    assert {r.doc_id for r in left.collect()} == {d for d, x in want.items() if not x[-1]}


def test_contamination_without_items_or_documents(spark, docs, work):
    from lapsekit.llm.shared import Work

    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.contamination(docs((1, "a b"), (1, "a b"), (2, None)), none, work).collect()
    assert sorted((r.doc_id, r.n_words, r.contaminated) for r in got) == [(1, 2, False), (1, 2, False), (2, 0, False)]
    assert decontaminate.contamination(docs((1, "x")).filter("false"), none, Work(spark, "x")).count() == 0


def test_contamination_joined_by_shuffle(spark, docs, work, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    rows = corpus(9, 20)
    items = [(1, rows[6][1]), (2, "one two")]
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.contamination(docs(*rows), spark.createDataFrame(items, "item_id long, text string"), work).collect()}
    assert got == brute.contamination(rows, items)


def test_decontamination_runs_no_python(spark, docs, work):
    out = decontaminate.contamination(docs((1, "a b c")), spark.createDataFrame([(1, "a b")], "item_id long, text string"), work)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("seed", [7, 8])
def test_lines(docs, work, seed):
    rng = random.Random(seed)
    line = lambda: " ".join(rng.choice(WORDS) for _ in range(12))
    common = line()
    near = [common[:-3] + x for x in ("abc", "xyz")]
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "ab"), (4, "ab\nab"), (4, "ab\nab"), (5, " " + common + "  "), (6, "é" * 3)]
    rows += [(i, "\n".join([line(), rng.choice([common, *near, "x", ""]), line()])) for i in range(10, 40)]
    rows += [(50, rows[-1][1]), (51, "\n".join(f"line {i} {common}" for i in range(300)))]
    out = lines.dedup_lines(docs(*rows), work)
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == brute.kept_lines(rows, lines.shingles, lines.SIMILARITY)
    assert out.count() == len(rows) and out.columns[:10] == docs((1, "")).columns


def test_lines_of_nothing(docs, work):
    assert lines.dedup_lines(docs((1, "x")).filter("false"), work).count() == 0


@pytest.mark.parametrize("limit", [1, 300, 1 << 20])
def test_lines_are_compared_exactly(limit, monkeypatch):
    """Short lines, NULs, code points beyond 16 bits and changed copies, in pieces of any size, against sets of strings."""
    monkeypatch.setattr(lines, "CHARACTERS", limit)
    rng = random.Random(limit)
    pool = []
    for _ in range(100):
        line = [rng.choice("ab \0é漢\U0001F600") for _ in range(rng.choice([1, 3, 6, 7, 8, 20, 80, 200]))]
        pool.append("".join(line))
        for _ in range(3):
            for _ in range(rng.randint(0, 2)):
                line[rng.randrange(len(line))] = rng.choice("ab\0")
            pool.append("".join(line))
    x = [rng.randrange(len(pool)) for _ in range(6000)]
    y = [i // 4 * 4 + rng.randrange(4) if rng.random() < 0.5 else rng.randrange(len(pool)) for i in x]
    sets = [lines.shingles(line) for line in pool]
    want = [10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) for i, j in zip(x, y, strict=True)]
    assert lines.all_similar(pool, x, y).tolist() == want and 100 < sum(want) < 5000
    assert lines.all_similar([], [], []).tolist() == []


def test_outlines_spare_most_comparisons(monkeypatch):
    """Lines that share much, but too little to be linked, are told apart without their shingles."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(60)]
    pool = [" ".join(word() if rng.random() < share else w for w in base) for share in [0.15] * 60 + [0.02] * 20]
    pool += ["ab", "abc", "\U0001F600" * 3, "a" * 9000, "a" * 9000 + "b", "x" * 40]
    x, y = (c.ravel() for c in np.meshgrid(np.arange(len(pool)), np.arange(len(pool))))
    whole, judged = [], lines._judged
    monkeypatch.setattr(lines, "_judged", lambda each, a, b: whole.append(len(a)) or judged(each, a, b))
    sets = [lines.shingles(line) for line in pool]
    want = [10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) for i, j in zip(x.tolist(), y.tolist(), strict=True)]
    assert lines.all_similar(pool, x, y).tolist() == want
    assert sum(want) <= sum(whole) < 0.4 * len(x)


def test_bands_of_many_lines_are_those_of_each(monkeypatch):
    rng = random.Random(6)
    pool = ["".join(rng.choice("ab é\U0001F600") for _ in range(rng.choice([1, 6, 7, 50, 300]))) for _ in range(60)]
    want = np.concatenate([lines.bands([line]) for line in pool])
    monkeypatch.setattr(lines, "HASHED", 200)
    assert (lines.bands(pool) == want).all()


def test_bands_find_similar_lines():
    rng = random.Random(1)
    found = 0
    for _ in range(200):
        a = "".join(rng.choice("abcdefgh ") for _ in range(150))
        b = a[:70] + "".join(rng.choice("xyz") for _ in range(8)) + a[78:]
        assert lines.similar(a, b)
        x = lines.bands([a, b, "unrelated line of text here"])
        found += bool((x[0] == x[1]).any())
        assert not (x[0] == x[2]).any()
    assert found >= 196


def test_components(spark, work):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1100)]
    links += [(5000, 5000 + i) for i in range(1, 60)] + [(7, 7), (None, 3)]
    union = brute.Union()
    for a, b in links:
        if a is not None and a != b:
            union.join(a, b)
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "x long, y long"), work).collect()}
    assert got == {n: union.find(n) for n in union.of}


def test_components_go_on_from_labels(spark, work):
    """Links in three parts, each part alone contracted, give what all links at once give; names are shuffled numbers."""
    rng = random.Random(4)
    names = rng.sample(range(-500, 500), 400)
    links = [(names[i], names[i + 1]) for i in range(150)] + [(rng.choice(names), rng.choice(names)) for _ in range(120)] + [(9000, 9000)]
    links += links[:20]
    rng.shuffle(links)
    union, labels = brute.Union(), None
    for a, b in links:
        if a != b:
            union.join(a, b)
    for k in range(4):
        some = links[100 * k : 100 * k + 100] if k < 3 else []
        labels = components(spark.createDataFrame(some, "x long, y long"), work, f"part{k}", labels)
    got = [(r.node, r.label) for r in labels.collect()]
    assert len(got) == len(dict(got)) and dict(got) == {n: union.find(n) for n in union.of}


def test_lists_without_sizes(spark, work):
    tokens = [(t, m) for t in range(40) for m in ([t, t, 99, 7] if t % 2 else [t, t])]
    plain = lists.shared_lists(spark.createDataFrame(tokens, "token long, member long"), work, "plain")
    sized = spark.createDataFrame([(*x, 1, 1, 0) for x in tokens], "token long, member long, size int, kind int, place int")
    sized = lists.shared_lists(sized, work, "sized")
    assert sorted(plain.collect()) == sorted(sized.collect()) and plain.schema == sized.schema and plain.count() == 59


def test_long_lists_are_cut_but_lose_no_link(spark, work, monkeypatch):
    monkeypatch.setattr(lists, "PART", 4)
    kinds = "token long, member long, size int, kind int, place int"
    tokens = spark.createDataFrame([(1, m, 10, 0, 0) for m in range(40)] * 3 + [(2, 99, 10, 0, 0)] * 2, kinds)
    # links only between neighbours, none with the pivot but 0-1
    verify = lambda pairs: pairs.filter("y - x = 1").select("x", "y")
    found = lists.shared_lists(tokens, work)
    assert found.count() == 40  # a member that comes with a token again is one row
    got = {r.node: r.label for r in lists.linked(found, work, verify, 0.8).collect()}
    assert got == dict.fromkeys(range(40), 0)


@pytest.mark.parametrize("size", [1, 9, 40, 300, 3000])
def test_outlines_rule_out_no_link(size):
    rng = np.random.default_rng(size)
    base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
    each = [base]
    for _ in range(60):
        kept = base[rng.random(size) > rng.random() * 0.3]
        each.append(np.concatenate([kept, rng.integers(0, 1 << 63, int(rng.integers(0, 1 + size // 4)), dtype=np.uint64)]))
    each = [x for x in each if len(x)]
    pairs = [(a, b) for a in range(len(each)) for b in range(a)]
    x, y = (np.array(c) for c in zip(*pairs, strict=True)) if pairs else (np.zeros(0, int), np.zeros(0, int))
    linked = [100 * len(np.intersect1d(each[a], each[b])) >= 80 * len(np.union1d(each[a], each[b])) for a, b in pairs]
    found = jaccard_join.promising([jaccard_join.outline(e) for e in each], x, y)
    assert not [p for p, link, ok in zip(pairs, linked, found, strict=True) if link and not ok]
    assert size < 300 or sum(found) < len(found)


def test_repeated_rows_are_one_node(docs, work):
    text = " ".join(WORDS[:40])
    rows = [(None, text)] * 300 + [(7, text + " end")] * 300 + [(8, text + "\nend of it all")] * 3
    got = {(r.doc_id, r.n_shingles) for r in jaccard_join.similar_documents(docs(*rows), work).collect()}
    assert got == {(None, 36), (7, 37), (8, 40)}
    nodes = work.spark.createDataFrame([(n, "t") for n in (1, 2, 2, 3, 3, 3, 2)], "node long, text string").repartition(3)
    assert sorted(r.node for r in lists.one_row_each(nodes, work, "nodes").collect()) == [1, 2, 3]
