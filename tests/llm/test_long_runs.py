"""Tokenising of texts with runs of millions of characters of one kind."""

import pytest
import tokenizers

from lodestone.llm import packing

N = 3_000_000
TEXTS = {
    "blanks": "a" + " " * N + "b", "newlines": "a" + "\n" * N + "b", "mixed": "a" + " \n\t" * (N // 3) + "b", "letters": "x" * N, "marks": "!" * N, "digits": "7" * N,
    "just under": "a" + " " * 4999 + "b " + " " * 4000, "just over": "a" + " " * 5000 + "b\t" + "\u00a0" * 6000, "special": "one" + " " * 6000 + "<|endoftext|> two",
}


@pytest.mark.parametrize("name", TEXTS)
def test_ids_equal_the_library(name):
    path = packing.public_vocabulary()
    got = packing.byte_bpe_encoder(packing.vocabulary_ranks(path))(TEXTS[name])
    assert got == tokenizers.Tokenizer.from_file(path).encode(TEXTS[name], add_special_tokens=False).ids


def test_packing_of_a_long_run(spark):
    df = spark.createDataFrame([(1, "a" + " " * 1_000_000 + "b"), (2, None)], "doc_id long, text string")
    got = packing.pack(df, packing.public_vocabulary()).groupBy("doc_id").sum("length").collect()
    want = len(tokenizers.Tokenizer.from_file(packing.public_vocabulary()).encode("a" + " " * 1_000_000 + "b", add_special_tokens=False).ids) + 1
    assert dict(map(tuple, got)) == {1: want, 2: 1}
