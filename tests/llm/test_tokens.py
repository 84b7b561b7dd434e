import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sojourn.llm import queries
from sojourn.llm.bpe import Encoder, Merger, RankQueue, decode, encode, load_ranks
from sojourn.llm.cache import Recent
from sojourn.llm.tokenfile import WordEncoder, read_token_files, token_folder, write_token_files

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PLAIN = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(RANKS), special_tokens={})
BYTES = Encoder(RANKS, public_tokenizers.PATTERN, 50)
LIBRARY = Tokenizer.from_file(WORDS)
LIBRARY.encode_special_tokens = True
WORD = WordEncoder(WORDS, 50)

TEXTS = [
    "", " ", "a", "  two  spaces ", "it's we'll\n\n\tx  y\n z", "\x1c\x85  a b　", "é" * 500, "a" * 5000, "ab" * 3001 + "c",
    "中文 字符 ١٢٣ ½ ǅ", "J̌ ẖ H̱ x̌́ İ Σ ΑΣ Σ.", "<|endoftext|> <|EndOfText|> x<|startoftext|>", "👩‍👩‍👧 🇩🇪", "1234567 12 3", "가 가",
    "'S 'LL don'T ''' 's", "word### next%%%, a*b", "\x00\x01 �",
]
ALPHABET = st.text(alphabet=st.one_of(st.sampled_from(" \n\t'aAsStTeéÉßJ̌́̈Σσ1½%.,-#|<>\x1c\x85  "), st.characters(exclude_categories=["Cs"])), max_size=60)


def byte_ids(text):
    return np.frombuffer(BYTES(text), dtype="<i4").tolist()


def word_ids(text):
    return np.frombuffer(WORD(text), dtype="<u4").tolist()


def test_queue_gives_lowest_rank_then_leftmost():
    rng = np.random.default_rng(1)
    queue, waiting = RankQueue(70_000), []
    for _ in range(3000):
        if waiting and rng.random() < 0.45:
            want = min(waiting)
            waiting.remove(want)
            assert queue.pop() == want
        else:
            waiting.append((int(rng.integers(70_000) ** rng.random()), int(rng.integers(1000))))
            queue.push(*waiting[-1])
    while waiting:
        waiting.remove(queue.pop())
    assert queue.pop() == (-1, -1) and not any(queue.words) and not queue.top


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids_as_the_libraries(text):
    assert byte_ids(text) == PLAIN.encode_ordinary(text)
    assert word_ids(text) == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(ALPHABET)
def test_random_texts(text):
    assert byte_ids(text) == PLAIN.encode_ordinary(text)
    assert word_ids(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_every_character_class():
    for start in range(0, 0x20000, 64):
        text = " ".join(f"a{chr(c)}b {chr(c)}{chr(c)}" for c in range(start, start + 64) if not 0xD800 <= c < 0xE000)
        assert byte_ids(text) == PLAIN.encode_ordinary(text), hex(start)
        assert word_ids(text) == LIBRARY.encode(text, add_special_tokens=False).ids, hex(start)


def test_long_pre_token():
    rng = np.random.default_rng(3)
    piece = bytes(rng.choice(list(b"etaoin"), 200_000).tolist())
    assert b"".join(PLAIN.decode_single_token_bytes(i) for i in Merger(load_ranks(RANKS))(piece)) == piece


def test_recent_keeps_a_bounded_number():
    seen = []
    cache = Recent(lambda k: seen.append(k) or k * 2, 3)
    assert [cache[k] for k in (1, 2, 3, 4, 1, 5, 6, 7, 8, 1)] == [2, 4, 6, 8, 2, 10, 12, 14, 16, 2]
    assert len(cache) <= 3 and len(cache.older) <= 3


def test_documents_against_the_libraries(spark, data):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op10_byte_bpe(spark, data).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        ids = PLAIN.encode_ordinary(text)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    files = {r.doc_id: r for r in queries.op6_token_files(spark, data).collect()}
    start = 0
    for i in sorted(texts):
        ids = LIBRARY.encode(texts[i], add_special_tokens=False).ids + [1]
        row = files.pop(i)
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not files


SCHEMA = "doc_id bigint, text string, ids int, bytes string, start int, part int"


def test_odd_rows(spark):
    rows = [(2, "b", 1, "x", 1, 1), (None, "n", 1, "x", 1, 1), (2, "b", 1, "x", 1, 1), (1, None, 1, "x", 1, 1), (2, "a", 1, "x", 1, 1), (5, "z" * 100_000, 1, "x", 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    texts = decode(encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert sorted(bytes(r.bytes).decode() for r in texts) == sorted(r[1] or "" for r in rows)
    manifest = write_token_files(docs, token_folder(spark), WORDS, end_id=1, vocabulary=70_000)
    back = sorted(read_token_files(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in back] == [None, 1, 2, 2, 2, 5]
    assert [r.start for r in back] == np.cumsum([0] + [r.n_tokens for r in back[:-1]]).tolist()
    assert [len(r.ids) // 4 for r in back] == [r.n_tokens for r in back] and back[1].n_tokens == 1
    empty = spark.createDataFrame([], SCHEMA)
    assert read_token_files(write_token_files(empty, token_folder(spark), WORDS, end_id=1, vocabulary=70_000)).count() == 0
    assert decode(encode(empty, RANKS, public_tokenizers.PATTERN), RANKS).count() == 0
