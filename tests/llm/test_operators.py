"""Each operator against brute force, on odd inputs: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from goldweave.llm import bpe, fingerprint, langid, neardup, packing, quality, sp_encode, tokencount, topk, toxicity, warc

PIECES, WORDS = (public_tokenizers.path(n) for n in ("piece_bpe_32k.model", "word_bpe_49k.json"))
ODD = ["", None, " ", "  two  spaces ", "\n\n", "a\nb", "▁x", "naïve 日本 𝒳\x00", "x" * 30_000, "word " * 20_000, "The cat sat on the mat.", "The cat sat on the mat.", "<s> </s> <unk>", "ǅ İ ß", "\t tab\x1cfs"]
DOCS = "doc_id long, text string, n_tokens string, score string, class string, node string, key string, piece string, length string"


def documents(spark, texts, first=1):
    """Rows with further columns whose names clash with those that operators make."""
    return spark.createDataFrame([(i, t, "x", "y", "z", "n", "k", "p", "l") for i, t in enumerate(texts, first)], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    docs = documents(spark, ODD)
    return docs.unionByName(docs.where("doc_id = 11")).unionByName(documents(spark, ["no id", None]).withColumn("doc_id", F.lit(None).cast("long")))


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, ["x"]).where("false")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_pieces_equal_the_library(library):
    random = np.random.default_rng(0)
    model = bpe.load(PIECES)
    codec = sp_encode.Codec(model)
    parts = [*" \n▁abc.,'é日😀\x00\t", "the", "   ", "▁▁", "###", *list(model.ids)[500:900]]
    for _ in range(3000):
        text = "".join(random.choice(parts) for _ in range(random.integers(0, 30)))
        ids = library.encode(text)
        assert model.encode(text) == codec.encode(text) == ids
        assert model.decode(ids) == library.decode(ids)
        assert sum(n * tokencount.pieces(model, u) for u, n in tokencount.pre_tokens(model, text).items()) == len(ids)
    for n in range(70):
        assert model.encode(" " * n + "the") == library.encode(" " * n + "the")


def test_decode_any_ids(library):
    random = np.random.default_rng(1)
    model = bpe.load(PIECES)
    for _ in range(2000):
        ids = [int(i) for i in np.where(random.random(10) < 0.5, random.integers(3, 259, 10), random.integers(0, 32000, 10))]
        assert model.decode(ids) == library.decode(ids), ids


def test_encode_digests(odd, none, library):
    rows = sp_encode.encode_digests(odd, PIECES).collect()
    assert len(rows) == odd.count() and sp_encode.encode_digests(none, PIECES).count() == 0
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows)
    want = Counter()
    for r in odd.collect():
        ids = library.encode(r.text or "")
        want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert got == want
    back = {r.doc_id: r.text for r in sp_encode.decode_ids(sp_encode.encode_texts(odd.where("doc_id is not null"), PIECES), PIECES).collect()}
    assert back[11] == ODD[10] and back[1] == ""


@pytest.mark.parametrize("head", [0, 3, 100_000])
def test_token_counts(odd, none, library, head):
    rows = tokencount.count_tokens(odd, PIECES, head=head).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "")), n > 4096) for r in odd.collect())
    assert Counter(tuple(r) for r in rows) == want
    assert tokencount.count_tokens(none, PIECES).count() == 0


def test_fingerprint_is_homomorphic():
    a, b, c = "one line", "two", "three"
    of = fingerprint.Fingerprint.of
    assert of([a, b, c]) == of([c, a, b]) == of([a]).insert(c, b) and of([a, b]) == of([a, b, c]).delete(c)
    assert of([a, a]) != of([a]) and of([a, b]) != of([a + b])
    assert fingerprint.Fingerprint.parse(str(of([a, b]))) == of([a, b])
    long = [f"paragraph {i} has words of its own {i * 7919}" for i in range(60)]
    whole, half, other = of(long), of(long[:30] + [x[::-1] for x in long[30:]]), of([x[::-1] for x in long])
    assert whole.near(whole) == 1 and 0.3 < whole.near(half) < 0.8 and whole.near(other) < 0.2


@pytest.mark.parametrize("partitions", [1, 3, 50])
def test_fingerprint_edits(odd, none, partitions):
    rows = fingerprint.fingerprint_edits(odd, partitions).collect()
    order = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in odd.collect()))
    want = Counter()
    for (known, i, text), (_, _, following) in zip(order, order[1:] + order[:1], strict=True):
        want[i if known else None, len(text), hashlib.sha256(fingerprint.edited(text, following).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add(r.fingerprint)
    assert by[11] == by[12] and len(by[1] | by[2]) == 1
    assert fingerprint.fingerprint_edits(none).count() == 0


def test_fingerprint_of_one_row(spark):
    row = fingerprint.fingerprint_edits(documents(spark, ["abcd"])).first()
    assert row.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and row.near_next == 1


def test_word_ids_equal_the_library():
    from tokenizers import Tokenizer

    library, words, random = Tokenizer.from_file(WORDS), packing.WordIds(WORDS), np.random.default_rng(2)
    parts = [*" \n\t\x1c\x85 abTHE'sΣσİßé日😀12.,<|", "́", "'ll", "<|endoftext|>", "ΑΣ", "\r\n"]
    for _ in range(3000):
        text = "".join(random.choice(parts) for _ in range(random.integers(0, 25)))
        assert np.frombuffer(words.ids([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_packing(odd, none):
    from tokenizers import Tokenizer

    library, rows = Tokenizer.from_file(WORDS), packing.pack(odd, WORDS).collect()
    want = Counter()
    for r in odd.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4")
            want[r.doc_id, k // 2048, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert packing.pack(none, WORDS).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece(seed, monkeypatch):
    random = np.random.default_rng(seed)
    lengths = np.concatenate([random.integers(1, 2049, 3000), np.full(1500, 700), np.full(400, 2048), random.integers(1, 60, 500 * seed)])
    counts = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
    plan = packing.make_plan(counts)
    used = defaultdict(list)
    for length, n in counts.items():
        first, run, at = plan.slots[length]
        for rank in range(n):
            i = np.searchsorted(first, rank, "right") - 1
            used[int(run[i] + rank - first[i])].append((int(at[i]), length))
    assert sorted(used) == list(range(plan.sequences))
    for parts in used.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    monkeypatch.setattr(packing, "patterns_of", lambda *_: [])  # best-fit alone
    assert np.ceil(lengths.sum() / 2048) <= plan.sequences <= packing.make_plan(counts).sequences * 1.005 + 1
    assert packing.make_plan({}).sequences == 0


def test_repeats_fit_the_histogram():
    patterns = [(1500, 548), (1024, 1024), (2048,)]
    repeats = packing.fit_repeats(patterns, {1500: 10, 548: 10, 1024: 8, 2048: 3})
    assert np.allclose(repeats, [10, 4, 3], atol=0.05)


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                label[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_texts(seed=3, groups=12, members=25):
    random, out = np.random.default_rng(seed), []
    shared = " ".join(f"common{i}" for i in range(40))
    for g in range(groups):
        base = [f"w{random.integers(0, 5000)}" for _ in range(random.integers(4, 120))]
        for _ in range(random.integers(1, members)):
            words = list(base)
            for _ in range(random.integers(0, 1 + len(base) // 8)):
                words[random.integers(0, len(words))] = f"e{random.integers(0, 9999)}"
            text = " ".join(words)
            out.append(text.upper() if random.random() < 0.1 else text + " " + shared if g % 4 == 0 else text)
    return out


def test_near_duplicates(spark, monkeypatch):
    texts = [*near_texts(), "", None, " \t\n", "one two", "ONE  two", "a b c d e", "a b c d e f", "x " * 5000, "x " * 5001]
    want = brute_components(list(enumerate(texts, 1)))
    for block in (512, 4):  # small blocks deal a key's members over many cells
        monkeypatch.setattr(neardup, "BLOCK", block)
        rows = neardup.near_duplicates(documents(spark, texts)).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want and len(rows) == len(texts)
        assert all(r.kept == (r.component_id == r.doc_id) for r in rows)


def test_near_duplicates_on_odd_rows(odd, none):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert [(r.component_id, r.kept) for r in rows if r.doc_id == 12] == [(11, False)]
    assert sum(r.doc_id == 11 for r in rows) == 2
    assert neardup.near_duplicates(none).count() == 0


def test_keys_are_shared_within_the_distance():
    random = np.random.default_rng(5)
    a = random.integers(0, 1 << 16, (300, neardup.SYMBOLS), dtype=np.uint16)
    b = a.copy()
    for row in b:
        row[random.choice(neardup.SYMBOLS, 31, replace=False)] ^= 1
    assert (neardup.keys(a) == neardup.keys(b)).any(1).all()


LANGUAGES = {"en": "the and of with that this was from", "de": "der und die nicht auch sich eine schön", "fr": "le la les une avec où être élève", "es": "el los que una con niño año señor"}


def language_rows(n=240, seed=4):
    random, names = np.random.default_rng(seed), list(LANGUAGES)
    return [(i, " ".join(random.choice(LANGUAGES[names[i % 4]].split(), 12)), names[i % 4]) for i in range(n)]


def test_language_id(spark):
    rows = [*language_rows(), (900, None, "en"), (901, "12 !? 34", "de"), (902, "", None), (903, "der und die nicht", None), (None, "le la les une avec", "fr")]
    found = langid.identify(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert all(by[i].lang_pred == lang for i, _, lang in language_rows()) and by[903].lang_pred == "de" and by[None].lang_pred == "fr" and not by[None].held_out
    assert {by[i].lang_pred for i in (900, 901, 902)} == {"und"} and all(0 <= r.score <= 1 for r in found)
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in language_rows())


def test_rare_languages_are_learned(spark):
    rows = [(i, f"the cat and the dog {i}", "en") for i in range(3000)] + [(5000 + i, f"żółw śpi pod łóżkiem {i}", "pl") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, 40)
    assert model.languages == ["en", "pl"] and model.predict("żółw śpi")[0] == "pl"


def test_language_id_without_labels(spark):
    docs = spark.createDataFrame([(1, "a text", None)], "doc_id long, text string, lang string")
    assert langid.identify(docs).first().lang_pred == "und" and langid.identify(docs.where("false")).count() == 0


@pytest.mark.parametrize("n", [2, 4, 7, 12, 40])
def test_codewords_differ(n):
    code = langid.codewords(n)
    assert len({tuple(c) for c in code}) == n and set(np.unique(code)) <= {-1, 1}
    if n > 2:
        assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= 2


def test_decoding_corrects_a_wrong_bit():
    code = langid.codewords(4)
    model = langid.Model(list("abcd"), code, np.ones(code.shape), np.zeros((langid.BUCKETS, code.shape[1])), np.zeros(code.shape[1]))
    for c in range(4):
        for wrong in range(code.shape[1]):
            margins = 3.0 * code[c]
            margins[wrong] *= -1
            assert model.decode(margins)[0] == "abcd"[c]
    assert model.decode(np.zeros(code.shape[1]))[2]


def labelled(spark, n=600):
    random, filler = np.random.default_rng(6), [f"f{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    texts, labels = [], []
    for i in range(n):
        words = list(random.choice(filler, 40))
        toxic = i % 3 == 0
        if toxic:
            words[random.integers(0, 40)] = random.choice(["idiot", "scum"])
        junk = i % 4 == 0
        texts.append((i, " ".join(w.upper() + "!!" for w in words) if junk else " ".join(words).capitalize() + "."))
        labels.append((i, 0 if junk else 1, int(toxic)))
    docs = spark.createDataFrame([(*t, "c", "d") for t in texts], "doc_id long, text string, score string, y string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("operator, label, threshold", [(toxicity.score_toxicity, "toxic", 0.5), (quality.score_quality, "quality", 0.3)])
def test_classifiers(spark, odd, none, operator, label, threshold):
    docs, labels = labelled(spark)
    rows = operator(docs, labels).collect()
    truth = {r.doc_id: r[label] for r in labels.collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in rows)
    more = operator(odd, labels.unionByName(labels.limit(3)).unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None)], labels.schema))).collect()
    assert len(more) == odd.count() and all(0 <= r.score <= 1 for r in more)
    assert operator(none, labels).count() == 0 and operator(odd, labels.where("false")).count() == odd.count()


def test_factors_learn_a_pair():
    """The label is that of the pair: neither term alone tells."""
    a, b, c = 1, 2, 3
    rows = [(1, [a, b]), (0, [a, c]), (0, [b, c]), (0, [c])] * 150
    model = toxicity.fit(rows, epochs=60)
    raw = lambda *t: model.bias + model.weight[[model.at[x] for x in t]].sum() + sum(model.factors[model.at[x]] @ model.factors[model.at[y]] for i, x in enumerate(t) for y in t[:i])
    assert raw(a, b) > 0 > max(raw(a, c), raw(b, c), raw(c))


def test_machine_leaves_no_term_out():
    """Of 400 telling terms each has a weight."""
    rows = [(int(i >= 200), [i, 1000 + k]) for i in range(400) for k in range(25)]
    model = toxicity.fit(rows)
    assert all(model.weight[model.at[i]] * (1 if i >= 200 else -1) > 0 for i in range(400))
    assert toxicity.BUCKETS >= 1 << 16 and len(model.weight) == len(model.factors) == toxicity.BUCKETS


def test_equal_texts_count_once(spark):
    docs, labels = labelled(spark)
    copied = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(600)) + " idiot"
    more = spark.createDataFrame([(100_000 + i, copied, "c", "d") for i in range(300)], docs.schema)
    marks = spark.createDataFrame([(100_000 + i, 1, 1) for i in range(300)], labels.schema)
    many = toxicity.train(docs.unionByName(more), labels.unionByName(marks))
    one = toxicity.train(docs.unionByName(more.where("doc_id = 100000")), labels.unionByName(marks))
    assert (many.weight == one.weight).all() and many.bias == one.bias


def test_risk_learns_from_unlabelled():
    random = np.random.default_rng(8)
    good, bad = random.normal(1, 0.5, (900, 6)), random.normal(-1, 0.5, (300, 6))
    trusted = np.hstack([np.ones((400, 1)), good[:400]]).astype(np.float32)
    unlabelled = np.hstack([np.ones((800, 1)), np.vstack([good[400:], bad])]).astype(np.float32)
    model = quality.fit(trusted, unlabelled, 500 / 800)
    margins = model.margins(unlabelled)
    assert np.mean((margins > 0) == (np.arange(800) < 500)) > 0.95


def brute_search(vectors, k=10, every=50):
    """Of an id that repeats, the longest code and of these the greatest counts."""
    codes = {}
    for i, v in vectors:
        if i is not None and v:
            code = [int(x is not None and not x <= 0) for x in v]
            codes[i] = max(codes.get(i, (0, [])), (len(code), code))
    near = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    return {(q, r, i, d) for q, (n, code) in codes.items() if q % every == 0 for r, (d, i) in enumerate(sorted((near(code, c), i) for i, (m, c) in codes.items() if m == n)[:k], 1)}


@pytest.mark.parametrize("n, width, cell", [(400, 64, 16), (5, 40, 8192), (300, 16, 64), (700, 200, 32)])
def test_topk(spark, monkeypatch, n, width, cell):
    monkeypatch.setattr(topk, "CELL", cell)  # small cells are many, and hot ones are split
    monkeypatch.setattr(topk, "COPIES", 10)
    random = np.random.default_rng(n)
    vectors = [(i, [float(x) for x in random.normal(0, 1, width)]) for i in range(n)]
    vectors += [(10_000 + i, vectors[0][1]) for i in range(30)]  # a code that many rows share
    vectors += [(50 * i, vectors[0][1]) for i in range(1000, 1030)]
    vectors += [(20_000 + i, [*vectors[0][1][: width // 2], *random.normal(0, 1, width - width // 2).tolist()]) for i in range(100)]  # equal segments
    vectors += [(30_000 + 25 * i, random.normal(0, 1, 16).tolist()) for i in range(20)]  # another width
    vectors += [(vectors[0][0], vectors[0][1]), (50, vectors[1][1]), (None, vectors[0][1]), (77_000, None), (77_050, []), (77_100, [1.0]), (77_150, [None, float("nan"), -1.0])]
    frame = spark.createDataFrame([(*v, 1) for v in vectors], "vec_id long, embedding array<double>, label int")
    rows = topk.search_embeddings(frame).collect()
    assert {tuple(r) for r in rows} == brute_search(vectors) and len(rows) == len(brute_search(vectors))
    assert topk.search_embeddings(frame.where("false")).count() == 0


def test_topk_equals_its_sql(spark, tmp_path):
    """On mixed widths, nulls and repeated ids."""
    import duckdb

    from goldweave.llm import queries

    random = np.random.default_rng(1)
    vectors = [(i, random.normal(0, 1, 16 + 16 * (i % 2)).tolist()) for i in range(200)] + [(50, random.normal(0, 1, 32).tolist()), (100, [0.0] * 16), (100, random.normal(0, 1, 16).tolist()), (None, [1.0]), (300, None), (350, [])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    duckdb.sql(f"create or replace view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = duckdb.sql(queries.OP6_SQL).fetchall()
    assert sorted(tuple(r) for r in queries.op6_topk(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "distance").collect()) == sorted(want)


PAGES = [(1, "http://a b", "x" * 200), (2, None, "x" * 200), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", "é" * 50), (7, "u", "é" * 50), (8, "u", "WARC/1.1\r\n\r\n" * 30), (9, "u", "y" * 99), (10, "u", "y" * 99), (11, "u", "z\r\n\r\n" * 40_000)]


def test_warc_round_trip(spark):
    frame = spark.createDataFrame([(*p, "c") for p in [*PAGES, PAGES[2]]], "page_id long, url string, html string, digest string")
    first, want = {}, Counter()
    for i, _, html in [*PAGES, PAGES[2]]:
        data = (html or "").encode()
        to = first.setdefault(data, i) if len(data) >= 100 else i
        want[i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if to != i else "response", to if to != i else None] += 1
    assert Counter(tuple(r) for r in warc.archive_digest(frame).collect()) == want
    assert warc.archive_digest(frame.where("false")).count() == 0


@pytest.mark.parametrize("compress", [False, True])
def test_long_urls_are_read_back(spark, tmp_path, compress):
    url = "data:text/html," + "u" * 200_000
    warc.write_archives(spark.createDataFrame([(1, url, "x"), (2, "u", "y")], "page_id long, url string, html string"), str(tmp_path / "a"), compress)
    rows = warc.read_archives(spark, str(tmp_path / "a")).collect()
    assert all(r.gap is None for r in rows) and {r.uri for r in rows} == {url, "u"}


def test_plain_archives_hold_the_same(spark, tmp_path):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    found = []
    for compress in (True, False):
        folder = str(tmp_path / str(compress))
        warc.write_archives(frame, folder, compress)
        rows = warc.read_archives(spark, folder).collect()
        assert all(r.gap is None for r in rows)
        found.append({(r.record_id, r.record_type, bytes(r.block)) for r in rows})
    assert found[0] == found[1] and len(found[0]) == len(PAGES)


def records(n=8):
    return [warc.build({"WARC-Type": "resource", "WARC-Record-ID": f"<urn:r:{i}>"}, f"body {i} ".encode() * (i + 1)) for i in range(n)]


@pytest.mark.parametrize("packed", [False, True])
def test_salvage(packed):
    parts = [warc.pack(r) if packed else r for r in records()]
    clean = list(warc.salvage(b"".join(parts)))
    assert [x.block for x in clean] == [f"body {i} ".encode() * (i + 1) for i in range(8)]
    damaged = list(parts)
    damaged[2] = damaged[2][:-20]  # cut short
    damaged[5] = damaged[5][:30] + b"\xff\xff\xff" + damaged[5][33:]  # bytes changed
    damaged.insert(7, b"junk WARC/1.1\r\nnothing" + warc.GZIP_MAGIC)
    data = b"".join(damaged)
    found = list(warc.salvage(data))
    kept = [int(x.headers["warc-record-id"][7:-1]) for x in found if isinstance(x, warc.Record)]
    assert kept == [0, 1, 3, 4, 6, 7]
    assert sum(isinstance(x, warc.Gap) for x in found) == 3
    assert found[0].start == 0 and found[-1].end == len(data) and all(a.end == b.start for a, b in zip(found, found[1:], strict=False))
    assert list(warc.salvage(b"")) == [] and [type(x) for x in warc.salvage(b"no archive")] == [warc.Gap]


def test_salvage_of_mixed_archives():
    numbers = lambda data: [int(x.headers["warc-record-id"][7:-1]) for x in warc.salvage(data) if isinstance(x, warc.Record)]
    r = records()
    body = warc.build({"WARC-Type": "resource", "WARC-Record-ID": "<urn:r:9>", "Content-Encoding": "gzip"}, warc.pack(b"no record"))
    assert numbers(b"XARC" + body[4:] + r[0] + r[1]) == [0, 1]  # a damaged plain record with a packed block
    assert numbers(warc.pack(r[0]) + r[1] + warc.pack(r[2]) + b"noise" + r[3] + warc.pack(r[4])) == [0, 1, 2, 3, 4]
    whole = list(warc.salvage(warc.pack(r[0] + b"noise" + r[1]) + warc.pack(b"".join(r[2:]))))
    assert [type(x) for x in whole] == [warc.Record, warc.Gap, *[warc.Record] * 7]
    assert numbers(warc.pack(r[0] + b"noise" + r[1]) + warc.pack(b"".join(r[2:]))) == list(range(8))


def test_read_archives_logs_gaps(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(records()[0] + b"noise" + records()[1])
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(warc.pack, records(3))))
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert sum(r.gap is None for r in rows) == 5 and [(r.end - r.start) for r in rows if r.gap] == [5]
