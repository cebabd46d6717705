import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import clashing, documents
from pyspark.sql import functions as F

from readcollapse.llm import common, language_id, quality

STEMS = {"en": "th he in er an re".split(), "de": "ei ch sch ün ge ß".split(), "ru": "пр ст но ть ов ра".split()}


def text_of(rng, lang, n=30):
    return " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_languages(spark):
    rng = random.Random(1)
    rows = [(i, text_of(rng, lang), lang, "s") for i, lang in enumerate(["en", "de", "ru"] * 60)]
    odd = [(1000, None, "en", "s"), (1001, "", None, "s"), (1002, "12 34 !!", "en", "s"), (1003, text_of(rng, "de", 20_000), None, None), (1004, "a", None, None)]
    odd += [rows[5], (None, text_of(rng, "ru"), None, None)]
    got = language_id.identify(clashing(documents(spark, rows + odd))).collect()
    assert len(got) == len(rows) + len(odd)
    want = {r[0]: r[2] for r in rows} | {1000: "und", 1001: "und", 1002: "und", 1003: "de", None: "ru"}
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 or r["doc_id"] is None and zlib.crc32(b"null") % 4 == 2)
        assert 0 <= r["score"] <= 1 and (r["doc_id"] == 1004 or r["lang_pred"] == want[r["doc_id"]])
    kept = language_id.accept(clashing(documents(spark, rows + odd)))
    assert kept.columns == clashing(documents(spark, [])).columns and kept.count() == len(rows) + 4
    foreign = [(2000, "αβγδε ζηθικ λμνξο πρστυ φχψω", None, None), (2001, "漢字 仮名 交じり", None, None), (2002, text_of(rng, "ru"), None, None)]
    docs = documents(spark, rows + foreign).withColumn("prediction", F.lit("taken"))
    ids = lambda df: {r["doc_id"] for r in df.collect()}
    # A text that no learned language explains goes, and so does one in a language that is not wanted.
    kept = language_id.accept(docs)
    assert ids(kept) == {r[0] for r in rows} | {2002} and kept.columns == docs.columns and kept.filter("prediction <> 'taken'").count() == 0
    assert ids(language_id.accept(docs, ["ru", "xx"])) == {r[0] for r in rows if r[2] == "ru"} | {2002}
    assert ids(language_id.accept(docs, least=0)) == {r[0] for r in rows + foreign} and ids(language_id.accept(docs, least=100)) == set()


def test_languages_without_labels(spark):
    rows = [(1, "some text", None, None), (2, None, None, None)]
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(documents(spark, rows)).collect()} == {("und", 0.0)}
    assert language_id.identify(documents(spark, [])).count() == 0


def test_accept_without_labels(spark):
    odd = [(90, None, None, None), (91, "", None, None), (92, "12 34 !!", None, None), (93, "漢字", None, None), (None, "été", None, None)]
    docs = clashing(documents(spark, [(i, "some text", None, "s") for i in range(20)] + odd))
    kept = language_id.accept(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {*range(20), 93, None}
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert language_id.accept(documents(spark, [(i, "some text", "en", "s") for i in held] + odd)).count() == len(held) + 2


def test_the_sample_is_bounded(spark):
    rows = [(i, f"text {i}", "ab"[i % 2], 1) for i in range(300)] + [(7, f"other {k}", "b", 2) for k in range(500)] + [(1000 + i, "x" * 4000, "c", 3) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, k int").withColumn("size", F.octet_length("text"))
    got, counts = common.labelled_sample(docs, "lang", 40, 1, ("k",), 10_000)
    assert counts == {"a": 150, "b": 650, "c": 20}
    taken = {x: sum(r["lang"] == x for r in got) for x in "abc"}  # ids that repeat leave fewer than could be taken
    assert taken["a"] == 40 and 20 < taken["b"] <= 40 and taken["c"] == 2
    assert len({(r["doc_id"], r["lang"]) for r in got}) == len(got) and all((r["doc_id"], r["text"], r["lang"], r["k"]) in set(rows) for r in got)
    assert len(common.labelled_sample(docs, "lang", 40, 1, (), 1)[0]) == 3


def test_folded_weights_equal_the_kernel_machine():
    """Scoring by one product gives what kernel values against the landmarks give."""
    rng = random.Random(2)
    labels = ["en", "de"] * 15
    texts = [text_of(rng, x) for x in labels]
    model = language_id.fit(texts, labels, landmarks=6)
    as_sets = np.concatenate(list(language_id._chunks(texts))).astype(float)
    unit = as_sets / np.sqrt(as_sets.sum(axis=1, keepdims=True))
    marks = unit[[i for name in ("de", "en") for i in [j for j, x in enumerate(labels) if x == name][:6]]]
    values, vectors = np.linalg.eigh(marks @ marks.T)
    good = values > 1e-8 * values.max()
    z = unit @ marks.T @ (vectors[:, good] / np.sqrt(values[good]))
    y = np.where(np.array(labels)[:, None] == np.array(["de", "en"]), 1.0, -1.0) / 15
    solved = np.linalg.solve(z.T @ z / 15 + language_id.RIDGE / 2 / 15 * np.eye(z.shape[1]), z.T @ y)
    assert model.decide(as_sets.astype(np.uint8)) == pytest.approx(z @ solved, abs=1e-3)


def test_presence_counts_ngrams_of_each_row_alone():
    data, offsets = language_id.utf8(pa.array(["ab", None, "abc", "AB"]))
    p = language_id.presence(data, offsets)
    assert p[1].sum() == 0 and p[0].sum() == 3 and p[2].sum() == 6 and (p[0] == p[3]).all() and (p[2] >= p[0]).all()


def test_quality(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        rows.append((i, text_of(rng, "en", 40) if good else text_of(rng, "en", 40).upper().replace(" ", "!! "), "en", "s"))
        labels.append((i, int(good), 0))
    odd = [(900, None, None, None), (901, "", None, None), (902, "word " * 20_000, None, None), rows[0]]
    marks = spark.createDataFrame([*labels, (None, 1, 0), (5, None, None), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(clashing(documents(spark, rows + odd)), marks).collect()
    assert len(got) == len(rows) + len(odd)
    known = {i: q for i, q, _ in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in known]
    assert len(held) > 40 and np.mean([r["predicted"] == known[r["doc_id"]] for r in held]) > 0.95
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    none = quality.classify(documents(spark, odd), marks.filter("false")).collect()
    assert {r["score"] for r in none} == {0.5} and quality.classify(documents(spark, []), marks).count() == 0


def test_quality_learns_from_metadata(spark):
    """Texts say nothing here; only a metadata column tells the classes apart."""
    rng = random.Random(8)
    docs = documents(spark, [(i, text_of(rng, "en", 10), "en", "good" if i % 2 else "bad") for i in range(300)] + [(999, "x", "en", None)])
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    hits = lambda **more: np.mean([(r["score"] >= 0.5) == r["doc_id"] % 2 for r in quality.classify(clashing(docs), marks, **more).collect() if r["held_out"]])
    assert hits() < 0.8 and hits(meta=[F.col("source")]) > 0.95


def test_scores_equal_the_sum_over_pairs():
    rng = np.random.default_rng(4)
    w, v = rng.normal(size=quality.SIZE).astype(np.float32), rng.normal(size=(quality.SIZE, quality.RANK)).astype(np.float32) / 10
    ids, x, begin = quality.features(pa.array(["some words, some", None, "X!"]), [pa.array(["a", "b", None])])
    got = quality._score(ids, x, begin, 0.5, w, v)
    for k in range(3):
        i, y = ids[begin[k] : begin[k + 1]], x[begin[k] : begin[k + 1]]
        assert len(set(i.tolist())) == len(i)
        pairs = sum(float(v[i[a]] @ v[i[b]]) * float(y[a]) * float(y[b]) for a in range(len(i)) for b in range(a))
        assert got[k] == pytest.approx(0.5 + float(w[i] @ y) + pairs, rel=1e-3, abs=1e-3)
