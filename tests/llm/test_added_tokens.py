import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sojourn.llm.tokenfile import library_encoder, read_token_files, token_folder, write_token_files

WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["see <|endoftext|> here", "a<|endoftext|>b.<|startoftext|>", "<|endoftext|>  <|EndOfText|> x", "\t<|endoftext|>\n<|startoftext|> é", "<|endoftext|", "plain words"]


@pytest.mark.parametrize("text", TEXTS)
def test_added_tokens_as_the_library_has_them(text):
    assert np.frombuffer(library_encoder(WORDS)(text), "<u4").tolist() == Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids


def test_files_hold_them(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    rows = read_token_files(write_token_files(docs, token_folder(spark), WORDS, end_id=1, vocabulary=49408)).collect()
    start, library = 0, Tokenizer.from_file(WORDS)
    for row, text in zip(sorted(rows, key=lambda r: r.doc_id), TEXTS):
        ids = library.encode(text, add_special_tokens=False).ids + [1]
        assert (row.start, row.n_tokens, zlib.crc32(row.ids)) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
