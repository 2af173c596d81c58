"""The pipeline against a version in plain Python of what its stages decide."""

import inspect

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from test_operators import LANGUAGES, brute_components, language_rows

pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean texts in four languages, copies, near copies, junk, and rows without text or id."""
    at = tmp_path_factory.mktemp("sf")
    clean = [(i, " ".join(w + str(i % 50) if k % 3 == 0 else w for k, w in enumerate(t.split() * 3)), lang) for i, t, lang in language_rows(320)]
    copies = [(1000 + i, clean[i][1], clean[i][2]) for i in range(40)]
    near = [(2000 + i, clean[i][1] + " end", clean[i][2]) for i in range(40, 60)]
    junk = [(3000 + i, " ".join(w.upper() + "!!" for w in clean[i][1].split()), clean[i][2]) for i in range(100)]
    odd = [(4000, None, None), (4001, "", "en"), (4002, "12 34 56 78", "en"), (None, clean[0][1], "en")]
    rows = [(i, t, lang, "s", len(t or "")) for i, t, lang in clean + copies + near + junk + odd]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(i, 1, 0) for i, *_ in clean[:160]] + [(i, 0, 0) for i, *_ in junk[:50]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages_are_as_asked():
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "language ID", "near-duplicates", "packing"]
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in pipeline.STAGES)


def test_decisions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs]
    for _, step in pipeline.STAGES[:3]:
        out = step(spark, seen[-1], folder)
        assert out.columns == docs.columns
        seen.append(spark.createDataFrame(out.collect(), docs.schema))
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    clean, junk = set(range(320)), set(range(3000, 3100))
    assert len(ids[1] & junk) < 10 and len(clean - ids[1]) < 5  # quality
    assert not ids[2] & {4000, 4001, 4002} and len((clean & ids[1]) - ids[2]) < 5  # language
    rows = [(r.doc_id, r.text) for r in seen[2].collect() if r.doc_id is not None]
    assert ids[3] - {None} == {i for i, (_, c) in brute_components(rows).items() if i == c}  # near-duplicates
    assert (None in ids[2]) == (None in ids[3])


def test_run(spark, folder):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, step in pipeline.STAGES[:3]:
        docs = step(spark, docs, folder)
    want = {(r.doc_id, len(library.encode(r.text, add_special_tokens=False).ids) + 1) for r in docs.collect()}
    assert {(r.doc_id, r.length) for r in rows} == want and len(rows) == len(want)


def test_empty_and_wider_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    none = docs.where("false").withColumn("score", F.lit(1)).withColumn("lang_pred", F.lit("x"))
    for _, step in pipeline.STAGES:
        assert step(spark, none, folder).count() == 0
    assert set(LANGUAGES) == {"en", "de", "fr", "es"}


def test_repeated_rows_and_ids(spark):
    """Of equal rows one stays; of an id with two texts each is compared on its own."""
    one, two, three = (" ".join(f"{p}{i}" for i in range(30)) for p in "abc")
    rows = [(1, one), (2, two), (2, two), (3, one), (3, three), (None, one), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], COLUMNS)
    out = [(r.doc_id, r.text) for r in pipeline.dedup_stage(spark, docs, "").collect()]
    kept = [t for i, t in out if i is not None]
    assert sorted(t or "" for t in kept) == sorted(["", one, two, three]) and (None, one) in out
