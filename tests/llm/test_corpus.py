"""Tokens, packing, archives, fingerprints, language, quality and the pipeline."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lapsekit.llm import fingerprints, language, packing, quality, queries, token_store, warc
from lapsekit.llm.shared import Work, crc_mod, read
from lapsekit.llm.tokens import Encoder

ODD = ["", None, "a", " a", "a  b\n\nc \n d", "\ta\xa0b  \t c", "x\x02 y \x02", "don't 'says ''s 12 3.5e", "\x1cfoo  bar\x85", "<|endoftext|> a"]
ODD += ["foo <|endoftext|> bar", "a<|startoftext|>b", "x <|ENDOFTEXT|> y", "a\u2003b", " lead", "trail ", "\nlead", "a \nb", "a\n b"]
ODD += ["word " * 3000, "éè ́x ΑΣ", "日本 語\n\n", "a\nb c\nd", "\r\n x"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_tokenizer(name):
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    texts = [t or "" for t in ODD] * 2
    want = [np.array(x.ids, "<u4").tobytes() for x in plain.encode_batch(texts, add_special_tokens=False)]
    encoder = Encoder(path)
    assert encoder.encode(texts) == want and encoder.encode(texts) == want


def test_token_files_round_trip(docs, work):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rows = [(i * 7 % 31, t) for i, t in enumerate(ODD)] + [(77, "again"), (77, "again"), (None, "no id")]
    stored = token_store.write_tokens(docs(*rows), path, 2, work)
    ordered = sorted(((-1 if i is None else i, t or "") for i, t in rows))
    ids = [plain.encode(t, add_special_tokens=False).ids + [2] for _, t in ordered]
    starts = np.cumsum([0, *map(len, ids)])[:-1].tolist()
    crc = [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    want = sorted(zip([i for i, _ in ordered], starts, map(len, ids), crc, strict=True))
    got = [(-1 if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in token_store.token_digests(stored).collect()]
    assert sorted(got) == want
    assert [r.tokens for r in stored.filter("doc_id = 77").collect()] == [plain.encode("again").ids + [2]] * 2


def test_token_files_layout_and_empty_table(spark, docs, work, tmp_path):
    import pyarrow.parquet as pq

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_store.token_digests(token_store.write_tokens(docs((1, "x")).filter("false"), path, 2, work, "none")).count() == 0
    token_store.encoded(docs(*[(i, f"text number {i} " * 50) for i in range(400)]), path, 2).write.options(**token_store.LAYOUT).parquet(f"{tmp_path}/t")
    file = next(x for x in (tmp_path / "t").iterdir() if x.suffix == ".parquet" and pq.ParquetFile(x).metadata.num_rows)
    columns = [pq.ParquetFile(file).metadata.row_group(0).column(i) for i in range(5)]
    assert "RLE_DICTIONARY" in columns[4].encodings and "DELTA_BINARY_PACKED" in columns[0].encodings
    assert columns[0].has_column_index and columns[4].has_offset_index
    plan = spark.read.parquet(f"{tmp_path}/t").filter("doc_id > 390").select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in plan and "GreaterThan(doc_id,390)" in plan


def check_packing(rows, tokenizer, size=2048):
    """Ids cut as stated; every sequence gapless and within its size; gives the number of sequences."""
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


def test_packing(docs, work):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(1, 3000)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "long " * 7000), (5, "repeated"), (5, "repeated"), (None, "no id")]
    got = packing.pack_documents(docs(*rows), path, work).collect()
    sequences = check_packing(got, path)
    total = sum(len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sum(r.length for r in got) == total and sequences <= 1.03 * -(-total // 2048) + 1
    pieces = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == 902)
    ids = plain.encode("long " * 7000, add_special_tokens=False).ids + [0]
    want = [(k, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    assert pieces == want
    assert packing.pack_documents(docs((1, "x")).filter("false"), path, Work(work.spark, "none")).count() == 0


def test_children_hold_every_piece_once():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 2048, 500).tolist()
    order = list(range(500))
    a = packing.best_fit(lengths, order, 2048)
    b = packing.best_fit(lengths, sorted(order, key=lambda i: -lengths[i]), 2048)
    child = packing.crossover(a, b, lengths, 2048, rng)
    assert sorted(i for c in child for i in c) == order and all(sum(lengths[i] for i in c) <= 2048 for c in child)
    best = packing.evolve(lengths, [a], 2048, 3)[0]
    assert len(best) <= min(len(a), len(b)) and sorted(i for c in best for i in c) == order


def pages(spark, *rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, key string").repartition(3)


def test_archives_round_trip(spark, work):
    rows = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, None, None), (4, "http://c\n d", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\n")]
    rows += [(6, "u", "big " * 200_000), (7, "u", "one"), (7, "u", "one"), (None, "u", "null id"), (8, "u", "null id")]
    index = work.keep(warc.write_archives(warc.with_type(pages(spark, *rows), work), f"{work.path}/a"), "index")
    assert index.count() == len(rows)
    got = warc.read_records(index, f"{work.path}/a").collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    last = {2: 2, 1: 2, 3: 4, 4: 4, 5: 5, 6: 6, 7: 7, None: 8, 8: 8}
    want = sorted(
        (str(i), len((t or "").encode()), digest(t), "response" if last[i] == i else "revisit", None if last[i] == i else last[i])
        for i, _, t in rows
    )
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    texts = {i: (t or "").encode() for i, _, t in rows}
    assert all(bytes(r.payload) == texts[r.page_id] for r in got if r.record_type == "response")
    one = warc.read_records(index.filter("page_id = 5"), f"{work.path}/a").collect()
    assert [r.page_id for r in one] == [5]
    none = warc.write_archives(warc.with_type(pages(spark, (1, "a", "b")).filter("false"), Work(spark, "none")), f"{work.path}/b")
    assert none.count() == 0


def test_small_payloads_are_all_responses(spark, work):
    typed = warc.with_type(pages(spark, (1, "a", "xy"), (2, "b", "xy"), (3, "c", "long enough"), (4, "d", "long enough")), work, 5)
    assert sorted((r.page_id, r["last"]) for r in typed.collect()) == [(1, None), (2, None), (3, 4), (4, 4)]


def test_ranges_are_joined():
    assert [x[:2] for x in warc.ranges([(0, 10), (10, 5), (15 + warc.GAP_BYTES + 1, 5)])] == [(0, 15), (15 + warc.GAP_BYTES + 1, 20 + warc.GAP_BYTES + 1)]


def test_fingerprints(docs):
    rng = random.Random(2)
    line = lambda: " ".join(f"w{rng.randrange(500)}" for _ in range(9)) + ". "
    rows = [(i, "\n".join(line() * rng.randrange(1, 4) for _ in range(rng.randrange(1, 200)))) for i in range(0, 60, 2)]
    rows += [(100, None), (101, ""), (102, rows[0][1]), (103, "same"), (104, "same"), (200, "x\n" * 50), (None, "no id")]
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs(*rows)).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0]), reverse=True)
    assert len(got) == len(rows)
    for (i, t), (_, following) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        text = fingerprints.edited(t or "", following or "")
        assert got[i].edited_sha256 == hashlib.sha256(text.encode()).hexdigest() and got[i].n_chars == len(t or "")
        a, b = set(fingerprints.digests(t or "").tolist()), set(fingerprints.digests(text).tolist())
        assert got[i].near_edited == (len(a & b) / len(a | b) if a | b else 1.0)
        c = set(fingerprints.digests(following or "").tolist())
        assert got[i].near_next == (len(a & c) / len(a | c) if a | c else 1.0)
    assert got[103].fingerprint == got[104].fingerprint and got[102].fingerprint == got[0].fingerprint != got[2].fingerprint


def test_fingerprints_of_few_and_repeated_rows(docs):
    assert fingerprints.fingerprints(docs((1, "x")).filter("false")).count() == 0
    (alone,) = fingerprints.fingerprints(docs((1, "a. b. c."))).collect()
    assert alone.near_next == 1.0 and alone.n_chars == 8
    assert fingerprints.fingerprints(docs((1, "a"), (1, "a"), (1, "b"))).count() == 3


def test_sketches_recover_differences():
    rng = np.random.default_rng(5)
    a, b = (np.unique(rng.integers(0, 1 << 63, 900, dtype=np.uint64)) for _ in range(2))
    a = np.union1d(a, b[:500])
    ours, theirs = fingerprints.differing(a, b)
    assert sorted(ours) == sorted(np.setdiff1d(a, b)) and sorted(theirs) == sorted(np.setdiff1d(b, a))


def test_large_sketches_use_all_cells():
    sketch = fingerprints.Sketch.of(np.random.default_rng(6).integers(1, 1 << 63, 50_000, dtype=np.uint64), fingerprints.CELLS * 4**9)
    third = sketch.cells // 3
    for k in range(3):
        assert np.flatnonzero(sketch.counts[k * third : (k + 1) * third])[-1] > 0.99 * third
    assert len(sketch.peel()[0]) == 50_000


def test_differences_in_parts(monkeypatch):
    found = np.random.default_rng(7).integers(1, 1 << 63, 9000, dtype=np.uint64)
    a, b = found[:6000], found[2000:]
    monkeypatch.setattr(fingerprints, "AT_ONCE", 1000)
    sketches = [fingerprints.Sketch.of(x, fingerprints.CELLS) for x in (a, b)]
    for sides in ([], sketches):
        ours, theirs = fingerprints.differing(a, b, *sides)
        assert set(ours) == set(a) - set(b) and set(theirs) == set(b) - set(a)


def test_language(spark, small):
    out = language.identify(
        read(spark, small, "documents").withColumn("h", crc_mod(4) == 2), F.col("h"), "doc_id", "lang", "h", "text"
    ).filter("h AND length(text) > 40").collect()
    assert len(out) > 30 and sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_language_of_odd_texts(docs):
    rows = [(i, f"word number {i} und so weiter") for i in range(20)] + [(50, None), (51, ""), (52, "123 !?"), (53, "x"), (53, "x")]
    got = language.identify(docs(*rows), F.lit(False), "doc_id", "text").collect()
    assert len(got) == 25
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {50, 51, 52} and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert {r.lang_pred for r in language.identify(docs(*rows), F.lit(True), "doc_id").collect()} == {"und"}
    assert language.identify(docs((1, "x")).filter("false"), F.lit(False), "doc_id").count() == 0


def test_quality(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    held = crc_mod(5) == 0
    model = quality.fit(docs, labels, ~held)
    out = quality.score(docs.withColumn("h", held), model, "doc_id", "h").join(labels, "doc_id").filter("h").collect()
    good, bad = ([r.score for r in out if r.quality == q] for q in (1, 0))
    assert len(bad) > 5 and np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([r.predicted == r.quality for r in out]) > 0.95


def test_quality_of_odd_texts(spark, docs):
    rows = [(1, "Good text, well made."), (2, "bad bad bad bad"), (3, None), (4, ""), (5, "bad bad bad bad"), (5, "bad bad bad bad")]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 0, 1), (9, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(docs(*rows), quality.fit(docs(*rows), labels, F.lit(True)), "doc_id").collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert quality.fit(docs(*rows), labels.filter("quality = 1"), F.lit(True)) is None
    assert {r.score for r in quality.score(docs(*rows), None, "doc_id").collect()} == {quality.CUT}
    assert quality.score(docs((1, "x")).filter("false"), None, "doc_id").count() == 0


def test_quality_threshold_covers_all_labelled_rows(spark, docs, monkeypatch):
    rng = random.Random(12)
    rows = [(i, " ".join("!" * rng.randrange(3) + "word" * rng.randrange(1, 4) for _ in range(30 + i % 50))) for i in range(600)]
    labels = spark.createDataFrame([(i, int(t.count("!") + rng.randrange(12) < 34)) for i, t in rows], "doc_id long, quality int")
    monkeypatch.setattr(quality, "PER_LABEL", 15)
    table = docs(*rows)
    model = quality.fit(table, labels, F.col("doc_id") % 5 != 0)
    found = quality.score(table.filter("doc_id % 5 != 0"), model, "doc_id").join(labels, "doc_id")
    bad, predicted = found.filter("quality = 0").count(), found.filter("predicted = 0").count()
    assert abs(bad - predicted) <= 1 and 0 < bad < 480


def test_pipeline_stages(spark, work, small):
    docs = read(spark, small, "documents")
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, "The end of it.\n" * 3)], "doc_id long, text string")
    docs = docs.unionByName(odd, allowMissingColumns=True).withColumn("token", F.lit(1))
    stages = [name for name, _ in corpus_pipeline.STAGES]
    assert stages == ["language", "lines", "near copies", "benchmark", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, work.keep(stage(spark, docs, small), name.replace(" ", "-"))
        if name != "packing":
            assert docs.columns == before.columns and docs.count() <= before.count()
        if name == "lines":
            assert docs.count() == before.count() and docs.filter("n_chars != length(text)").isEmpty()
    assert sum(r.length for r in docs.collect()) > 0 and check_packing(docs.collect(), None)


CLASHING = ["score", "rejected", "lang_pred", "k0", "_row", "row", "whole", "_lines", "lines", "doc", "_doc", "th", "kept", "n_lines", "uid", "member", "a.b"]


def test_stages_keep_columns_of_any_name(spark, work, small):
    docs = read(spark, small, "documents").withColumns({c: F.lit(f"of {c}") for c in CLASHING})
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = work.keep(stage(spark, docs, small), f"clash-{name.replace(' ', '-')}")
        assert docs.columns == names
        for c in CLASHING:
            assert [r[0] for r in docs.select(F.col(f"`{c}`")).distinct().collect()] == [f"of {c}"]


def test_equal_rows_are_sampled_one_by_one(spark):
    rows = [(1, "the same text", "en", "s", 1)] * 5000 + [(2, "ein anderer Text", "de", "s", 1)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.lang: r["count"] for r in language.sample(docs, F.lit(True)).groupBy("lang").count().collect()}
    assert found["de"] == 5 and 1300 < found["en"] < 1700


def test_other_scripts_are_rejected(spark, small):
    model = language.fit(read(spark, small, "documents"), F.lit(True))
    texts = ["Это совсем другой язык, которого нет в выборке.", "这是一段中文文本,没有出现在样本中。"]
    rows = [(i, t) for i, t in enumerate(texts)]
    found = language.predict(spark.createDataFrame(rows, "doc_id long, text string"), model, "doc_id").collect()
    assert [r.rejected for r in found] == [True, True]
    own = language.predict(read(spark, small, "documents").filter("length(text) > 200"), model, "doc_id")
    assert own.filter("rejected").count() <= 0.02 * own.count()


def test_pipeline_run_and_empty_tables(spark, work, small, tmp_path):
    assert corpus_pipeline.run(spark, small).count() > 100
    for table in ("documents", "benchmark"):
        read(spark, small, table).filter("false").write.parquet(f"{tmp_path}/empty/{table}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, small, work, name):
    from oracle import differences, duck

    assert differences(queries.QUERIES[name](spark, small), duck(small), queries.ORACLES[name]) == []


TABLES = [(n, "pages" if n == "op2_warc" else "documents") for n in queries.QUERIES if n not in queries.ORACLES and n not in ("pipeline", "op4_packing", "op11_conversation_repair")]


@pytest.mark.parametrize("name, table", TABLES)
def test_queries_give_a_row_for_each_input_row(spark, small, work, name, table):
    assert queries.QUERIES[name](spark, small).count() == read(spark, small, table).count()


def test_registered():
    import __spark_entry__

    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert [f"op{n}_" for n in range(1, 14)] == sorted({k.split("_")[0] + "_" for k in queries.QUERIES if k != "pipeline"}, key=lambda x: int(x[2:-1]))
