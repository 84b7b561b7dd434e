import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sojourn.llm import queries
from sojourn.llm.pairtree import PATTERN, Merges, PairTree, merge_pieces, merge_side_by_side, tree_decode, tree_encode
from sojourn.llm.pretokens import PieceIds, slices

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
MERGES = Merges(PATH)
IDS = PieceIds(PATTERN, lambda pieces: merge_pieces(MERGES, pieces), MERGES.added, cache_bytes=2000)

TEXTS = [
    "", " ", "a", "  two  spaces ", "it's we'll\n\n\tx  y\n z", "\x1c\x85  a b　", "é" * 500, "a" * 5000, "ab" * 3001 + "c",
    "中文 字符 ١٢٣ ½ ǅ", "<|endoftext|> <|EndOfText|> x<|endoftext|><|endoftext|>y <|endoftext|", "a  <|endoftext|>  b", "👩‍👩‍👧 🇩🇪",
    "1234567 12 3", "가 가", "'S 'LL don'T ''' 's", "\x00\x01 �", " a", "a ", "\n", "a \n b", "x\ny z  w",
]
ALPHABET = st.text(alphabet=st.one_of(st.sampled_from(" \n\t'aAsStTeéÉßJ̌1½%.,-#|<>\x1c\x85  "), st.characters(exclude_categories=["Cs"])), max_size=60)


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def expected(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids_as_the_library(text):
    assert ids(IDS.text(text)) == expected(text)


def test_laid_out_together():
    flat, ends = IDS.lay_out(pa.array(TEXTS))
    assert [flat[a:b].tolist() for a, b in zip([0, *ends], ends)] == [expected(t) for t in TEXTS]
    flat, ends = IDS.lay_out(pa.array([], pa.string()))
    assert len(flat) == len(ends) == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(ALPHABET, min_size=1, max_size=4))
def test_random_texts(texts):
    flat, ends = IDS.lay_out(pa.array(texts))
    assert [flat[a:b].tolist() for a, b in zip([0, *ends], ends)] == [expected(t) for t in texts]


def test_every_character_class():
    for start in range(0, 0x20000, 256):
        text = " ".join(f"a{chr(c)}b {chr(c)}{chr(c)}" for c in range(start, start + 256) if not 0xD800 <= c < 0xE000)
        assert ids(IDS.text(text)) == expected(text), hex(start)


def test_trees_take_the_leftmost_lowest_rank():
    """Against a scan for the least rank at each step, one tree and trees side by side."""
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 8, 9, 31, 64):
        piece = bytes(rng.choice(list(b"etaoin sh"), n).tolist())
        row = MERGES.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        while True:
            found = [MERGES.by_pair.get(pair, (np.inf, -1)) for pair in zip(row, row[1:])]
            if not found or min(found)[0] == np.inf:
                break
            at = found.index(min(found))
            row[at : at + 2] = [found[at][1]]
        assert PairTree(MERGES, piece).ids() == row
        symbol = np.full((64, 2), -1)
        symbol[:n, 0] = symbol[:n, 1] = MERGES.byte_id[np.frombuffer(piece, np.uint8)]
        both = merge_side_by_side(MERGES, symbol)
        assert [both[both[:, i] >= 0, i].tolist() for i in (0, 1)] == [row, row]


def test_long_pre_token_equals_library():
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("etaoin"), 60_000).tolist())
    assert ids(IDS.text(text)) == expected(text)


def test_slices_hold_whole_rows():
    texts = pa.array(["a" * 10, "b" * 100, "", "c", "d" * 5])
    assert list(slices(texts, 12)) == [(0, 1), (1, 2), (2, 5)]
    assert list(slices(pa.array([], pa.string()), 12)) == []


def test_operator_keeps_rows_and_round_trips(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (2, "", "y"), (3, "é <|endoftext|>\n 中 " * 300, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, IDS string")
    for binary in (False, True):
        coded = tree_encode(docs, PATH, binary=binary)
        out = tree_decode(coded.withColumn("DECODED", coded["doc_id"]), PATH).collect()
        assert sorted((r["doc_id"] or 0, r["text"] or "", r["decoded"]) for r in out) == sorted((d or 0, t or "", t or "") for d, t, _ in rows)
    empty = tree_decode(tree_encode(docs.limit(0), PATH), PATH)
    assert empty.count() == 0
    odd = spark.createDataFrame([([255, 187],), (None,), ([],)], "ids array<int>")
    assert [r["decoded"] for r in tree_decode(odd, PATH).collect()] == [LIBRARY.decode([255, 187], skip_special_tokens=False), None, ""]


def test_query_equals_library(spark, data):
    rows = {r["doc_id"]: r for r in queries.op13_pair_tree(spark, data).collect()}
    docs = queries.documents(spark, data).collect()
    assert len(rows) == len(docs)
    for doc in docs:
        want = expected(doc["text"] or "")
        row = rows[doc["doc_id"]]
        assert row["n_tokens"] == len(want)
        assert row["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(want, skip_special_tokens=False).encode()).hexdigest()
