"""Operators against second computations in plain Python, and cases that only show at size: many partitions, hot keys, repeated rows."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from goldweave.llm import fingerprint, langid, neardup, packing, quality, sampling, toxicity, warc
from goldweave.llm.common import fit_once
from test_operators import documents, labelled, language_rows


def plain_fingerprint(text):
    dense, sketch = [0] * 8, [0] * 256
    for paragraph in text.split("\n") if text else ():
        digest = hashlib.blake2b(paragraph.encode(), digest_size=64).digest()
        dense = [(d + int.from_bytes(digest[8 * i : 8 * i + 8], "little")) % 2**64 for i, d in enumerate(dense)]
        codes = [0] * 7 + [ord(c) for c in paragraph]
        for i in range(7, len(codes)):
            if codes[i] == 0:
                continue
            h = 0
            for c in codes[i - 7 : i + 1]:
                h = (h * 0x9E3779B97F4A7C15 + c) % 2**64
            h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 % 2**64
            sketch[(h >> 55) % 256] += 1 if h >> 55 < 256 else -1
    return dense, sketch


def plain_near(a, b):
    if a == b:
        return 1.0
    size = math.sqrt(sum(x * x for x in a[1]) * sum(x * x for x in b[1]))
    return max(0.0, min(1.0, sum(x * y for x, y in zip(a[1], b[1], strict=True)) / size)) if size else 0.0


def test_fingerprints_equal_plain_ones(spark):
    texts = ["one line", "two\nlines of it", "", None, "naïve 日本 𝒳\x00 end", "one line", "word " * 40, "a\n\nb\n", "the same words in another order"]
    rows = {r.doc_id: r for r in fingerprint.fingerprint_edits(documents(spark, texts), 3).collect()}
    for i, text in enumerate(texts):
        text, following = text or "", texts[(i + 1) % len(texts)] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        own, other, after = map(plain_fingerprint, (text, changed, following))
        row = rows[i + 1]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        for told, want in ((row.fingerprint, own), (row.edited_fingerprint, other)):
            found = fingerprint.Fingerprint.parse(told)
            assert found.dense.tolist() == want[0] and found.sketch.view(np.int32).tolist() == want[1]
        assert row.near_edited == pytest.approx(plain_near(own, other)) and row.near_next == pytest.approx(plain_near(own, after))


def test_likeness_of_long_repetitive_texts():
    of = fingerprint.Fingerprint.of_text
    assert of("x" * 70_000).near(of("x" * 63_000)) > 0.99


def test_fingerprints_of_many_partitions(spark):
    docs = spark.range(3000).selectExpr("id * 7 doc_id", "concat('text ', id) text")
    rows = {r.doc_id: r for r in fingerprint.fingerprint_edits(docs, 1200).collect()}
    for i in range(3000):
        text, following = f"text {i}", f"text {(i + 1) % 3000}"
        half = len(text) // 2
        assert rows[7 * i].edited_sha256 == hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()


def scan_batches(plan):
    """Batches that the scans of an executed plan have read."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return scan_batches(plan.executedPlan())
    if plan.nodeName().endswith("QueryStage"):
        return scan_batches(plan.plan())
    own = plan.metrics().apply("numInputBatches").value() if plan.nodeName() == "ColumnarToRow" else 0
    return own + sum(scan_batches(plan.children().apply(i)) for i in range(plan.children().size()))


def test_fingerprints_scan_few_texts_at_a_time(spark, tmp_path):
    key = "spark.sql.parquet.columnarReaderBatchSize"
    spark.range(2000).selectExpr("id doc_id", "repeat(string(id), 200) text").coalesce(1).write.parquet(str(tmp_path / "documents"))
    spark.conf.set(key, "4096")
    try:
        found = fingerprint.fingerprint_edits(spark.read.parquet(str(tmp_path / "documents")))
        assert len({r.doc_id for r in found.collect()}) == 2000
        assert scan_batches(found._jdf.queryExecution().executedPlan()) >= 2000 / fingerprint.SCAN_ROWS
        spark.conf.set(key, "100")
        fingerprint.fingerprint_edits(spark.read.parquet(str(tmp_path / "documents")))
        assert spark.conf.get(key) == "100"  # a lower setting stays
    finally:
        spark.conf.unset(key)


def test_languages_equal_a_plain_decoding(spark):
    rows = [(i, t, lang) for i, t, lang in language_rows(200)] + [(500, "the der la", None), (501, "x" * 50_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs.where("lang is not null"))
    for r in langid.predict(docs, model).collect():
        data, counts = (" " + r.text.lower() + " ").encode(), Counter()
        for n in langid.ORDERS:
            for i in range(len(data) - n + 1):
                gram = int.from_bytes(data[i : i + n], "big") + n
                counts[(gram * 2654435761 % 2**32) >> 20] += 1
        norm = math.sqrt(sum(counts.values()))
        margin = [model.bias[b] + sum(math.sqrt(c) / norm * model.linear[at, b] for at, c in counts.items()) for b in range(model.code.shape[1])]
        loss = [sum(model.weight[k, b] * math.log1p(math.exp(-model.code[k, b] * margin[b])) for b in range(len(margin))) for k in range(len(model.languages))]
        best = min(range(len(loss)), key=loss.__getitem__)
        assert r.lang_pred == model.languages[best] and r.score == pytest.approx(math.exp(-loss[best]) / sum(math.exp(-x) for x in loss), abs=1e-4)


def test_toxicity_equals_a_sum_over_pairs(spark):
    docs, labels = labelled(spark, 200)
    model = toxicity.train(docs, labels)
    for r in toxicity.score_texts(docs, model).limit(60).collect():
        places = sorted({zlib.crc32(w.encode()) % toxicity.BUCKETS for w in "".join(c if c.isalpha() else " " for c in r.text.lower()).split()})
        raw = model.bias + sum(model.weight[p] for p in places)
        raw += sum(float(model.factors[p] @ model.factors[q]) for i, p in enumerate(places) for q in places[:i])
        assert r.score == pytest.approx(1 / (1 + math.exp(-raw)), abs=1e-6)


def test_quality_equals_a_plain_sum(spark):
    docs, labels = labelled(spark, 200)
    model = quality.train(docs, labels)
    for r in quality.score_texts(docs, model).limit(60).collect():
        x = quality.featurise(r.text)
        raw = sum(float((x[i] - model.mean[i]) * model.scale[i] * model.weight[i]) for i in range(len(x)))
        assert r.score == pytest.approx(1 / (1 + math.exp(-(model.slope * raw + model.shift))), abs=1e-4)


def plain_risk(w, p, u, prior):
    """The unbiased risk's parts: of trusted texts as good, and of unlabelled ones as bad without the trusted share."""
    soft = lambda z: math.log1p(math.exp(-abs(z))) + max(z, 0)
    mean = lambda rows, s: sum(soft(s * float(r @ w)) for r in rows) / len(rows)
    return prior * mean(p, -1), mean(u, 1) - prior * mean(p, 1)


def test_quality_minimises_the_risk():
    random = np.random.default_rng(4)
    good, bad = random.normal(0.7, 1, (700, 4)).astype(np.float32), random.normal(-0.7, 1, (200, 4)).astype(np.float32)
    one = lambda x: np.hstack([np.ones((len(x), 1), np.float32), x])
    p, u = one(good[:400]), one(np.vstack([good[400:], bad]))
    model = quality.fit(p, u, 0.6, steps=600, decay=0.0)
    pn, un = ((x - model.mean) * model.scale for x in (p, u))
    risk = lambda w: (lambda a, b: a + max(0.0, b))(*plain_risk(w, pn, un, 0.6))
    assert all(risk(model.weight) <= risk(model.weight + 0.3 * random.normal(0, 1, 5).astype(np.float32)) + 1e-3 for _ in range(20))


@pytest.mark.parametrize("share", [0.5, 0.85])
def test_prior_is_estimated_from_unlabelled_texts(share):
    random = np.random.default_rng(5)
    n = int(1000 * share)
    good, bad = random.normal(1.5, 1, (800 + n, 5)).astype(np.float32), random.normal(-1.5, 1, (1000 - n, 5)).astype(np.float32)
    one = lambda x: np.hstack([np.ones((len(x), 1), np.float32), x])
    order = random.permutation(1000)
    assert abs(quality.estimate_prior(one(good[:800]), one(np.vstack([good[800:], bad])[order])) - share) < 0.06


def test_samples_hold_an_id_once(spark):
    """One id with 5,000 rows: as many rows as before would have gone to the fit for each time that it was chosen."""
    docs = spark.range(5000).selectExpr("7L doc_id", "concat('the cat and the dog ', id) text", "'en' lang").unionByName(spark.range(50).selectExpr("id + 100 doc_id", "'der hund und die katze' text", "'de' lang"))
    chosen = sampling.lowest(docs.select("doc_id"), 200)
    assert chosen.count() == 51 and sampling.texts_of(docs, chosen, "doc_id").count() == 51
    assert sampling.lowest_each(docs.select("doc_id", "lang"), "lang", 10).groupBy("lang").count().collect() in ([("de", 10), ("en", 1)], [("en", 1), ("de", 10)])
    assert langid.train(docs).languages == ["de", "en"]
    labels = docs.selectExpr("doc_id", "int(lang = 'en') toxic", "int(lang = 'de') quality")
    assert toxicity.score_toxicity(docs, labels, 20).count() == quality.score_quality(docs, labels, 20).count() == 5050


def test_scores_replace_columns_of_their_name(spark):
    docs, labels = labelled(spark, 60)
    docs = docs.withColumn("lang", F.lit("en")).withColumn("lang_pred", F.lit("x")).withColumn("ambiguous", F.lit(1))
    for scored in (toxicity.score_texts(docs, toxicity.train(docs, labels)), quality.score_texts(docs, quality.train(docs, labels)), langid.predict(docs, langid.train(docs))):
        assert scored.select("score").dtypes == [("score", "double")] and len(set(scored.columns)) == len(scored.columns) and scored.count() == 60
    assert langid.predict(docs, langid.train(docs)).first().lang_pred == "en"


def test_fits_run_once_and_on_nothing(spark):
    rows = spark.range(100).repartition(7)
    assert fit_once(rows, lambda t: sum(t["id"].to_pylist())) == 4950 and fit_once(rows.where("false"), lambda t: len(t)) == 0


def test_many_documents_share_a_passage(spark):
    """A hub of all documents: only the planted copies are linked."""
    random = np.random.default_rng(2)
    passage = " ".join(f"licence{i}" for i in range(40))
    own = [" ".join(f"w{n}" for n in random.integers(0, 10**6, 25)) for _ in range(1500)]
    texts = [f"{passage} {o}" for o in own] + [f"{passage} {o} end" for o in own[:40]]
    rows = neardup.near_duplicates(documents(spark, texts, 0)).collect()
    assert {r.doc_id: r.component_id for r in rows} == {i: i if i < 1500 else i - 1500 for i in range(1540)}


def test_blocks_grow_with_their_hub(spark, monkeypatch):
    """Any two members of a hub meet, and members have a bounded number of copies until blocks are widest."""
    for name, value in (("BLOCK", 4), ("WIDEST", 32), ("SPREAD", 4)):
        monkeypatch.setattr(neardup, name, value)
    for n, copies in ((3, 1), (10, 3), (16, 4), (100, 4), (300, 10)):
        rows = spark.range(n).selectExpr("7L hub", "id node", f"{n}L n", "id component", "cast(repeat('a', 160) as binary) signature", "cast(repeat('b', 2048) as binary) fine")
        dealt = neardup._blocks(rows)
        cells = [set(r.nodes) for r in dealt.groupBy("cell").agg(F.collect_set("node").alias("nodes")).collect()]
        assert {(a, b) for c in cells for a in c for b in c} == {(a, b) for a in range(n) for b in range(n)}
        assert dealt.count() == n * copies
        assert neardup._across(dealt).count() == n * (n - 1) // 2


def test_busy_documents_are_confirmed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CELL_PAIRS", 4)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words)] + [" ".join([*words, f"e{i}"]) for i in range(80)] + [" ".join(f"x{i}{k}" for k in range(60)) for i in range(20)]
    pairs = spark.createDataFrame([(0, i) for i in range(1, 101)] + [(i, 100) for i in range(1, 100)], "a long, b long")
    assert {tuple(r) for r in neardup.confirm(pairs, documents(spark, texts, 0)).collect()} == {(0, i) for i in range(1, 81)}


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        packing.WordIds(public_tokenizers.path("byte_bpe_50k.json"))


def test_tokenizer_file_is_read_once_a_process(monkeypatch):
    import public_tokenizers

    path, texts = public_tokenizers.path("word_bpe_49k.json"), ["Straße, ÀÉ don't <|x αβγ a1b2 ﬁ", "plain ǅ words\x1cand µ others", ""]
    first = packing.WordIds(path).ids(texts)
    monkeypatch.setattr(packing.json, "load", None)
    assert packing.WordIds(path).ids(texts) == first == [np.array(packing._tokenizer(path).encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_large_pages_are_archived_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 200_000)  # 100 bytes are small
    pages = [(i, "u", "x" * 40 + str(i)) for i in range(30)] + [(100 + i, "u", "y" * 90_000 + str(i % 2)) for i in range(5)]
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), str(tmp_path / "a"))
    rows = warc.read_archives(spark, str(tmp_path / "a")).collect()
    assert Counter(r.record_type for r in rows) == {"response": 32, "revisit": 3} and all(r.gap is None for r in rows)
    assert max(Counter(r.path for r in rows if r.payload_length > 1000).values()) <= 2


def test_a_gap_in_a_fresh_archive_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(warc, "VERSION", b"XARC/1.1")
    with pytest.raises(Exception, match="a fresh archive has a gap"):
        warc.archive_digest(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")).collect()
