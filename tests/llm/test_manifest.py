"""The Merkle manifest against a plain version."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lapsekit.llm import manifest, queries
from lapsekit.llm.shared import read

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, rank int, digest string, salt int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enter(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, text):
    return h(*(enter(x) for x in (row.doc_id, row.source, row.lang, row.n_chars, text)))


def tree(nodes):
    """The root, and for each node the siblings of each level as (left, right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for k, place in enumerate(at):
            run, j = runs[place // 8], place % 8
            paths[k].append((run[:j], run[j + 1 :]))
        at = [place // 8 for place in at]
        nodes = [h(*run) for run in runs]
    return nodes[0], paths


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(rows):
    first = lambda x, key=lambda x: x: (x is not None, 0 if x is None else key(x))
    rows = sorted(rows, key=lambda r: (first(r.lang, str.encode)[0], b"" if r.lang is None else r.lang.encode(), first(r.doc_id), leaf_of(r, r.text)))
    langs = []
    for r in rows:
        if not langs or langs[-1][0].lang != r.lang:
            langs.append([])
        langs[-1].append(r)
    trees = [tree([leaf_of(r, r.text) for r in part]) for part in langs]
    root, above = tree([x for x, _ in trees]) if trees else (None, [])
    out = []
    for part, (subroot, paths), top in zip(langs, trees, above, strict=True):
        for r, path in zip(part, paths, strict=True):
            steps = path + top
            touched = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
            have = leaf_of(r, lower(r.text) if touched else r.text)
            for left, right in steps:
                have = h(*left, have, *right)
            out.append((r.doc_id, leaf_of(r, r.text), subroot, root, h(*(x for s in steps for side in s for x in side)), have, have == root))
    return sorted(out, key=str)


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA).repartition(4)


def tampered():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0


@pytest.mark.parametrize("counts", [{"en": 1}, {"en": 8, "de": 9}, {"en": 65, "de": 1, None: 3, "": 8, "é": 64}, {str(k): 1 + k % 3 for k in range(70)}])
def test_proofs(spark, work, counts):
    rng = random.Random(len(counts))
    ids = iter(rng.sample(range(10_000), sum(counts.values())))
    text = lambda: rng.choice(["", "No Upper" * 40, "lower", "É1", "A\nB", None, "Q" * 50_000])
    rows = [(next(ids), text(), lang, rng.choice([None, "", "s:1"]), rng.choice([None, 3])) for lang, n in counts.items() for _ in range(n)]
    df = made(spark, rows)
    got = manifest.proofs(df, work, tampered())
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(df.collect())


def test_repeated_rows_null_ids_and_nothing(spark, work):
    rows = [(5, "Same", "en", "s", 4)] * 30 + [(None, "Null Id", "en", None, None)] * 3 + [(5, "Other", "en", "s", 5), (6, None, None, None, None)]
    df = made(spark, rows)
    got = sorted(map(tuple, manifest.proofs(df, work, tampered()).collect()), key=str)
    assert got == plain(df.collect()) and len(got) == len(rows)
    assert manifest.proofs(df.filter("false"), manifest.Work(spark, "none"), tampered()).count() == 0


def test_query(spark, small):
    got = queries.QUERIES["op12_merkle_manifest"](spark, small).collect()
    assert sorted(map(tuple, got), key=str) == plain(read(spark, small, "documents").collect())
    assert {r.verified for r in got} == {True, False}


def test_runs_no_python(spark, work):
    plan = manifest.proofs(made(spark, [(1, "a", "en", None, 1)]), work)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
