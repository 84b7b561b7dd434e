import public_tokenizers
import pytest
import tiktoken
from test_exact_and_mixing import brute_targets

import corpus_pipeline as pipeline
from sojourn.llm.bpe import load_ranks
from sojourn.llm.mixing import mix_report
from sojourn.llm.simhash import shingles
from sojourn.llm.store import saved

STAGES = dict(pipeline.STAGES)
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _file string, score double"


@pytest.fixture(scope="module")
def docs(spark, data):
    """The documents with repeated ids, copies, near copies, nulls and clashing columns among them."""
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    long = max((r[1] for r in rows), key=len)
    rows += [rows[0], (rows[1][0], rows[2][1], None, None, 1), (None, rows[3][1], "en", "src0", 2), (-5, long + " end", "en", "src1", 3), (7001, None, None, "src2", 0), (7002, "", "en", None, 0), (7003, "漢字 漢語", None, "src3", 5)]
    return saved(spark.createDataFrame([(*r, "f", 0.1) for r in rows], SCHEMA), "documents")


def rows_of(frame):
    return sorted(((r.doc_id, r.text, r.source) for r in frame.collect()), key=repr)


def test_language_keeps_all_clean_documents(spark, docs, data):
    got = pipeline.language(spark, docs, data)
    assert got.columns == docs.columns
    gone = [(7001, None, "src2"), (7002, "", None), (7003, "漢字 漢語", "src3")]
    assert rows_of(got) == [r for r in rows_of(docs) if r not in gone]


def test_exact_keeps_one_row_of_each_text(spark, docs, data):
    got = pipeline.exact(spark, docs, data)
    assert got.columns == docs.columns
    best = {}
    for i, text, _ in rows_of(docs):
        key = text or ""
        if key not in best or (i is not None and (best[key] is None or i > best[key])):
            best[key] = i
    assert sorted(((i, t or "") for i, t, _ in rows_of(got)), key=repr) == sorted(((i, t) for t, i in best.items()), key=repr)


def jaccard_components(texts, least=0.8):
    sets = [set(shingles(t, 5)) for t in texts]
    root, having = list(range(len(sets))), {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for x in s or {None} for j in having.get(x, ())}:
            both = len(s & sets[j])
            if both >= least * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for x in s or {None}:
            having.setdefault(x, []).append(i)
    return [find(i) for i in range(len(sets))]


def test_near_finds_nearly_all_similar_pairs(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").dropDuplicates(["text"])
    rows = [(r.doc_id, r.text) for r in table.collect()]
    groups = len(set(jaccard_components([t for _, t in rows])))
    kept = pipeline.near(spark, saved(table, "table"), "").count()
    assert groups <= kept <= groups + 0.1 * (len(rows) - groups)


def test_near_keeps_one_document_of_each_group(spark, docs, data):
    got = pipeline.near(spark, docs, data)
    rows = rows_of(docs)
    roots = jaccard_components([t for _, t, _ in rows])
    first = {}
    for (i, _, _), root in zip(rows, roots):
        first.setdefault(root, []).append(i)
    want = [min((i for i in ids if i is not None), default=None) for ids in first.values()]
    assert sorted((i for i, _, _ in rows_of(got)), key=repr) == sorted(want, key=repr)


def test_mixture_repeats_documents(spark, docs, data):
    got = rows_of(pipeline.mixture(spark, docs, data))
    sizes = {}
    for _, text, source in rows_of(docs):
        sizes[source] = sizes.get(source, 0) + len((text or "").encode().split())
    targets = brute_targets(sizes)
    report = mix_report(docs).collect()
    assert all(abs(r.target - targets[r.source]) < 1e-6 * max(1, r.target) for r in report)
    assert all(int(r.target / max(1, r.source_size)) <= r.copies <= int(r.target / max(1, r.source_size)) + 1 for r in report)
    assert len(got) == sum(r.copies for r in report)


def test_tokens_against_the_library(spark, docs, data):
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(pipeline.RANKS), special_tokens={})
    got = sorted(((r.doc_id, tuple(r.ids), r.n_tokens) for r in pipeline.tokens(spark, docs, data).collect()), key=repr)
    want = [(i, tuple(plain.encode_ordinary(t or ""))) for i, t, _ in rows_of(docs)]
    assert got == sorted(((i, ids, len(ids)) for i, ids in want), key=repr)


def test_whole_run(spark, data):
    got = pipeline.run(spark, data)
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids"] and got.filter("size(ids) = n_tokens").count() == got.count() > 0


@pytest.mark.parametrize("name", list(STAGES))
def test_no_rows(spark, docs, data, name):
    empty = saved(docs.limit(0), "none")
    assert STAGES[name](spark, empty, data).count() == 0
