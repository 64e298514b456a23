"""Registered queries and pipeline stages against plain versions in Python."""

import math
import re
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lapsekit.llm import language, lines, packing, quality
from lapsekit.llm.shared import crc_mod, read

LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
LETTER = re.compile(r"[^\W\d_]")


def pieces_of(rows, size=2048):
    """Counter of (doc_id, piece, start, length, crc) by the plain tokenizer."""
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = Counter()
    for doc_id, text in rows:
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for k, a in enumerate(range(0, len(ids), size)):
            out[doc_id, k, a, len(ids[a : a + size]), zlib.crc32(ids[a : a + size].tobytes())] += 1
    return out


def check_places(rows, size=2048):
    """Sequences are gapless from 0 and within their size; gives their number."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert 0 < at <= size
    return len(by)


def test_packing_query_holds_every_piece(spark, small, work):
    rows = [tuple(r) for r in read(spark, small, "documents").select("doc_id", "text").collect()]
    got = packing.op4_packing(spark, small).collect()
    want = pieces_of(rows)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert check_places(got) == -(-sum(k[3] * n for k, n in want.items()) // 2048)


def parts_of(spark, lengths):
    rows = [(i, i, 0, 0, n, 0) for i, n in enumerate(lengths)]
    return spark.createDataFrame(rows, packing.PIECES).repartition(4)


def test_blocks_share_their_emptiest_bins(spark, work, monkeypatch):
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 300, 1200).tolist() + [2048] * 3
    monkeypatch.setattr(packing, "BLOCK", 100)
    got = packing.packed(parts_of(spark, lengths), work, 2048).collect()
    assert sorted((r.doc_id, r.length) for r in got) == list(enumerate(lengths))
    assert check_places(got) <= -(-sum(lengths) // 2048) + 1


def test_pieces_that_never_share_a_bin(spark, work, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 10)
    got = packing.packed(parts_of(spark, [1100] * 100), work, 2048).collect()
    assert len(got) == 100 and check_places(got) == 100


def triplets(seed, n=167, size=2048):
    """Pieces that fill ``n`` sequences exactly, three in each."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        a = int(rng.integers(int(0.3 * size), int(0.48 * size)))
        b = int(rng.integers(int(0.4 * (size - a)), (size - a) // 2))
        out += [a, b, size - a - b]
    return [int(x) for x in rng.permutation(out)]


def test_generations_beat_best_fit():
    for seed in range(3):
        lengths = triplets(seed)
        order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
        plain = packing.best_fit(lengths, order, 2048)
        best = packing.evolve(lengths, [], 2048, seed)[0]
        assert len(best) <= 173 < len(plain) and sorted(i for b in best for i in b) == list(range(len(lengths)))
        assert max(sum(lengths[i] for i in b) for b in best) <= 2048


def test_exchange_keeps_pieces_and_fills_bins():
    lengths = [500, 700, 300, 900, 510, 705]
    opened, left = packing.exchange([(20, [0, 1]), (0, [2])], [3, 4, 5], lengths)
    assert sorted([i for _, b in opened for i in b] + left) == list(range(6))
    assert all(space >= 0 and space == s + sum(lengths[i] for i in a) - sum(lengths[i] for i in b) for (s, a), (space, b) in zip([(20, [0, 1]), (0, [2])], opened, strict=True))
    assert opened[0][0] < 20 and sum(lengths[i] for i in left) < 900 + 510 + 705


def language_scores(text, model):
    """Probabilities by language, from bucket counts one gram at a time."""
    data = (text or "").encode().translate(LOWER)
    x = np.zeros(language.BUCKETS)
    for n in (3, 4):
        for i in range(len(data) - n + 1):
            key = int.from_bytes(data[i : i + n], "little")
            x[(key * (2654435761 + 2 * n) % 2**32) >> 20] += 1
    z = (x / max(x.sum(), 1) @ model.table + model.bias) / model.temperature
    p = [math.exp(v - max(z)) for v in z]
    return [v / sum(p) for v in p]


def strange(text, model):
    data = (text or "").encode().translate(LOWER)
    pairs = [a | b << 8 for a, b in zip(data, data[1:], strict=False)]
    return sum(not model.seen[k] for k in pairs) / max(1, len(pairs))


def test_language_query_equals_plain_scores(spark, small):
    docs = read(spark, small, "documents")
    model = language.fit(docs, crc_mod(4) != 2)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = language.op6_language(spark, small).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        p = language_scores(texts[r.doc_id], model)
        lettered = bool(LETTER.search(texts[r.doc_id] or ""))
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert abs(r.score - (max(p) if lettered else 0)) < 1e-4
        if not lettered or max(p) - sorted(p)[-2] > 1e-4:
            assert r.lang_pred == (model.languages[int(np.argmax(p))] if lettered else "und")


def quality_features(text):
    data = (text or "").encode()
    size, words = max(1, len(data)), re.findall(rb"[^\x20\x09-\x0d]+", data)
    total = max(1, len(words))
    count = lambda p: len(re.findall(p, data)) / size
    classes = [rb"[a-z]", rb"[A-Z]", rb"[0-9]", rb"[\x80-\xff]", rb" ", rb"\n", rb"[.,;:'\"()?-]", rb"\|", rb"!"]
    kinds = [count(p) for p in classes]
    kinds.append(count(rb"[^a-zA-Z0-9\x80-\xff \n.,;:'\"()?|!-]"))
    other = re.compile(rb"[^a-zA-Z0-9\x80-\xff \n.,;:'\"()?|!-]\Z")
    share = lambda hits: sum(hits) / total
    values = kinds + [
        share(a == b for a, b in zip(words, words[1:], strict=False)),
        share(a == b for a, b in zip(words, words[2:], strict=False)),
        len(set(words)) / total / math.log2(total + 2),
        share(bool(other.search(w)) for w in words),
        share(w.endswith(b"!") for w in words),
        share(bool(re.match(rb"[A-Z]([A-Z]|\Z)", w)) for w in words),
        share(len(w) == 1 for w in words),
        min(sum(map(len, words)) / total, 40) / 40,
        math.log2(size) / 32,
    ]
    return np.sqrt(values)


def test_quality_query_equals_plain_scores(spark, small):
    docs, labels = read(spark, small, "documents"), read(spark, small, "labels")
    model = quality.fit(docs, labels, crc_mod(5) != 0)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = quality.op3_quality(spark, small).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        x = (quality_features(texts[r.doc_id]) - model.mean) / model.scale
        rank = sum(max(-6.0, min(6.0, v)) * w for v, w in zip(x, model.weights, strict=True))
        z = math.log(quality.CUT / (1 - quality.CUT)) + model.slope * (rank - model.threshold)
        want = 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))
        assert abs(r.score - want) < 1e-3 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_pipeline_equals_plain_stages(spark, small, work, tmp_path):
    docs = read(spark, small, "documents").orderBy("doc_id").limit(120)
    item = read(spark, small, "benchmark").filter("length(text) > 100").first().text
    text = docs.filter("length(text) > 400").orderBy("doc_id").first().text
    more = [(9001, None), (9002, ""), (9003, text + " and a little more."), (9004, f"Some words before it. {item} Some words after it."), (9005, "12 34")]
    planted = spark.createDataFrame(more, "doc_id long, text string")
    work.keep(docs.unionByName(planted, allowMissingColumns=True), "in").write.parquet(f"{tmp_path}/sf/documents.parquet")
    read(spark, small, "benchmark").write.parquet(f"{tmp_path}/sf/benchmark.parquet")
    folder = f"{tmp_path}/sf"
    docs = read(spark, folder, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]

    model = language.fit(docs, F.lit(True))
    sure = lambda t: max(language_scores(t, model))
    rows = [
        (d, t) for d, t in rows
        if LETTER.search(t or "") and sure(t) >= model.reject_below and strange(t, model) < language.UNFAMILIAR
    ]
    left = brute.kept_lines(rows, lines.shingles, lines.SIMILARITY)
    assert any(left[d] != (t or "") for d, t in rows)
    rows = sorted(left.items())
    groups = brute.components(rows)
    rows = [(d, t) for d, t in rows if groups[d] in ((0, d), (groups[d][0], d))]
    hit = brute.contamination(rows, [tuple(r) for r in read(spark, folder, "benchmark").select("item_id", "text").collect()])
    assert any(h[4] for h in hit.values())
    rows = [(d, t) for d, t in rows if not hit[d][4]]

    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces_of(rows)
    check_places(got)
