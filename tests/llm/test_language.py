import zlib

import numpy as np

from sojourn.llm import queries
from sojourn.llm.langid import BLOCK, Model, cluster, fit, identify, ngram_counts, vector


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.op4_language(spark, folder).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got) and {r.lang_pred for r in got} <= {"de", "en", "es", "fr"}
    assert not any(r.rejected for r in got)


def test_nearest_centroid_against_plain_numpy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = fit(docs)
    got = {r.doc_id: r for r in identify(docs, model).collect()}
    for r in docs.collect():
        cosine = model.centroids @ vector(ngram_counts(r.text), model.idf)
        assert got[r.doc_id].lang_pred == model.languages[int(np.argmax(cosine))]
        assert abs(got[r.doc_id].score - cosine.max()) < 1e-5


def test_document_frequencies_are_those_of_all_texts(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    counts = [ngram_counts(r.text) for r in docs.collect()]
    want = np.log((1 + len(counts)) / (1 + sum((c > 0).astype(int) for c in counts))) + 1
    assert np.allclose(fit(docs).idf, want, atol=1e-5)


def test_rejects_what_is_far_and_keeps_short_texts(spark, data):
    model = fit(spark.read.parquet(f"{data}/documents.parquet"))
    rows = [(1, "The onthan and the"), (2, "привет как дела сегодня"), (3, "漢字漢語漢文"), (4, None), (5, "123 ... !"), (6, ""), (7, "the " * 700_000)]
    docs = spark.createDataFrame([(i, t, "mine", 0.5) for i, t in rows], "doc_id bigint, text string, lang_pred string, extra double")
    got = {r.doc_id: r for r in identify(docs, model).collect()}
    assert [got[i].rejected for i in range(1, 8)] == [False, True, True, True, True, True, False]
    assert [got[i].lang_pred for i in (4, 5, 6)] == ["und"] * 3 and got[4].score == 0
    assert got[1].lang_pred == got[7].lang_pred == "en" and got[1].extra == 0.5


def test_no_labels_and_no_rows(spark):
    schema = "doc_id bigint, text string, lang string"
    docs = spark.createDataFrame([(1, "some text", None), (None, "more", None)], schema)
    model = fit(docs)
    assert model.languages == [] and identify(docs, model).filter("lang_pred = 'und' and rejected").count() == 2
    empty = spark.createDataFrame([], schema)
    assert identify(empty, fit(empty)).count() == 0
    same = spark.createDataFrame([(1, "abc abc", "x")] * 5 + [(None, "xyz xyz", "y"), (2, "...", "z")], schema)
    model = fit(same)
    assert set(model.languages) == {"x", "y"}
    assert {(r.text, r.lang_pred) for r in identify(same, model).collect()} == {("abc abc", "x"), ("xyz xyz", "y"), ("...", "und")}


def test_blocks_do_not_lose_letters():
    text = "ab " * (BLOCK // 3 + 10)
    assert ngram_counts(text).sum() > ngram_counts(text[:BLOCK]).sum()
    assert ngram_counts("a\ud800b") is not None


def test_clusters_are_unit_vectors_apart():
    rng = np.random.default_rng(4)
    middle = np.eye(3, 20, dtype=np.float32)
    rows = np.concatenate([m + 0.05 * rng.random((50, 20), dtype=np.float32) for m in middle])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    found = cluster(rows, 3)
    assert np.allclose(np.linalg.norm(found, axis=1), 1, atol=1e-5)
    assert sorted(np.argmax(found[:, :3], axis=1)) == [0, 1, 2]
    assert isinstance(Model(["x"], found, rows[0]).languages, list)


def test_null_and_repeated_ids_are_drawn_like_others(spark):
    rows = [(None, f"the house and the dog {i} were in the garden with them", "en") for i in range(300)]
    rows += [(7, f"la maison et le chien {i} sont dans le jardin avec eux", "fr") for i in range(300)]
    rows += [(8, "der hund und das haus sind im garten mit ihnen", "de")] * 300 + [(i, f"el perro y la casa {i} en el patio con ellos", "es") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = fit(docs, sample=40)
    assert set(model.languages) == {"en", "fr", "de", "es"}
    found = identify(docs, model).filter("lang_pred <> lang").count()
    assert found == 0
