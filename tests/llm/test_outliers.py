"""Quality rules against plain versions: counts in Python, concentration steps in numpy."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lapsekit.llm import outliers, queries
from lapsekit.llm.shared import Work, read

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, w int, row string, n int, m double, group string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    out = (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside))
    return (*out, n < 50 or 100 * len(inside) > 50 * n)


def vector(c):
    n, chars, symbols, dup, rep = c[:5]
    return [math.log(1 + n), math.log(chars / n), math.sqrt(symbols / chars), math.sqrt(dup / n), math.sqrt(rep / n)]


FLOOR = np.square(outliers.FLOORS)


def moments(x, factor):
    return x.mean(0), factor * np.cov(x.T, bias=True) + np.diag(FLOOR)


def distances(x, estimate):
    at = x - estimate[0]
    return np.einsum("ij,jk,ik->i", at, np.linalg.inv(estimate[1]), at)


def robust(x):
    """Squared distances by concentration steps from both starts."""
    order = np.sort(np.floor(x * outliers.PLACES + 0.5) / outliers.PLACES, axis=0)
    low, mid, high = (order[math.ceil(q * len(x)) - 1] for q in (0.25, 0.5, 0.75))
    starts = [(mid, np.diag(((high - low) / 1.349) ** 2 + FLOOR)), moments(x, 1.0)]
    for k in range(outliers.STEPS):
        new = []
        for s in starts:
            bins = np.floor(np.log2(distances(x, s) + 1e-6) * outliers.BINS)
            new.append(moments(x[bins <= np.sort(bins)[math.ceil(outliers.CORE * len(x)) - 1]], outliers.CONSISTENT))
        moved = max(abs(np.linalg.slogdet(a[1])[1] - np.linalg.slogdet(b[1])[1]) for a, b in zip(starts, new, strict=True))
        starts = new
        if k and moved <= outliers.STILL:
            break
    best = min(starts, key=lambda s: np.linalg.slogdet(s[1])[1])
    return distances(x, moments(x[distances(x, best) <= outliers.INNER], 1.0))


def plain(rows):
    """Per row: doc_id, counts, base_failed, distance or None, kept. Rows: (doc_id, text, lang, source, ..)."""
    found = [(r[0], *counts(r[1])) for r in rows]
    good = [k for k, c in enumerate(found) if not c[-1]]
    cells, tongues = Counter((rows[k][2], rows[k][3]) for k in good), Counter()
    for (lang, _), n in cells.items():
        tongues[lang] += n if n < outliers.LEAST_ROWS else 0
    rest = sum(n for n in tongues.values() if n < outliers.LEAST_ROWS)
    groups = defaultdict(list)
    for k in good:
        lang, source = rows[k][2], rows[k][3]
        if cells[lang, source] >= outliers.LEAST_ROWS:
            groups[lang, source].append(k)
        elif tongues[lang] >= outliers.LEAST_ROWS:
            groups[lang, "all others"].append(k)
        elif rest >= outliers.LEAST_ROWS:
            groups["all others"].append(k)
    far = {}
    for members in groups.values():
        far |= dict(zip(members, robust(np.array([vector(found[k][1:]) for k in members])), strict=True))
    return [(*c, far.get(k), not c[-1] and (k not in far or far[k] <= outliers.OUTER)) for k, c in enumerate(found)]


def agree(got, want):
    got, want = sorted(map(tuple, got), key=str), sorted(want, key=str)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: (str(r[:7]), r[8])), sorted(want, key=lambda r: (str(r[:7]), r[8])), strict=True):
        assert g[:7] == w[:7] and g[8] == w[8]
        assert (g[7] is None) == (w[7] is None) and (g[7] is None or math.isclose(g[7], w[7], rel_tol=1e-6, abs_tol=1e-9))


def text(rng, n=None, junk=False):
    n = n or rng.randrange(55, 400)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(n)]
    if junk:
        words = [rng.choice(["###", "$$$%%%", "<<>>", "word"]) + w for w in words]
    return "\n".join(" ".join(words[i : i + 11]) for i in range(0, n, 11))


def corpus(seed):
    rng = random.Random(seed)
    out = [(1, None), (2, ""), (3, " \t\n\x0b"), (4, "a b c " * 100), (5, "x\n" * 60), (6, "é#  ü\n\n" * 30), (7, text(rng, 30_000)), (8, "one two"), (9, "a b c"), (10, "a a a a")]
    out = [(*r, "en", "big") for r in out]
    for i in range(20, 500):
        lang, source = rng.choice([("en", "big")] * 6 + [("de", "s1"), ("de", "s2"), (None, None), ("xx", "s"), ("yy", "s"), (None, "s")])
        repeated = "\nthe same line\nthe same line" if i % 17 == 0 else ""
        out.append((i, text(rng, junk=i % 29 == 0) + repeated, lang, source))
    return out + [out[-1]] * 5 + [(None, out[-1][1], "en", "big")]


def made(spark, rows):
    return spark.createDataFrame([(*r, 3, 1, "x", 2, 0.5, "g") for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("seed", [1, 2])
def test_judged(spark, work, seed):
    rows = corpus(seed)
    got = outliers.judged(made(spark, rows), work)
    assert got.columns == ["doc_id", *outliers.NAMES, "base_failed", "distance", "kept"]
    got = got.collect()
    agree(got, plain(rows))
    junk = {r[0] for r in rows if r[0] and r[0] >= 20 and r[0] % 29 == 0 and (r[2], r[3]) == ("en", "big")}
    assert junk and not junk & {r.doc_id for r in got if r.kept}


def test_few_rows_and_none(spark, work):
    rows = corpus(3)[:25]
    got = outliers.judged(made(spark, rows), work).collect()
    agree(got, plain(rows))
    assert all(r.distance is None and r.kept != r.base_failed for r in got)
    assert outliers.judged(made(spark, rows).filter("false"), Work(spark, "none")).count() == 0


def test_equal_vectors_are_kept(spark, work):
    rows = [(i, "\n".join(f"w{k} x{k} y{k}" for k in range(30)), "en", "s") for i in range(80)]
    assert {(r.kept, round(r.distance, 6)) for r in outliers.judged(made(spark, rows), work).collect()} == {(True, 0.0)}


def test_query(spark, small):
    got = queries.QUERIES["op13_quality_rules"](spark, small)
    assert got.columns == ["doc_id", *outliers.NAMES, "base_failed", "kept"]
    want = plain([(r.doc_id, r.text, r.lang, r.source) for r in read(spark, small, "documents").collect()])
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(*r[:7], r[8]) for r in want], key=str)


def test_runs_no_python(spark, work):
    plan = outliers.judged(made(spark, corpus(1)), work)._jdf.queryExecution().executedPlan().toString()
    plan += outliers.statistics(made(spark, corpus(1)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
