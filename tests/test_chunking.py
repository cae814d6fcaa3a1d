"""Chunks and compounds on small texts."""

from lodestone.functions.chunking import sentence_chunks, sentence_chunks_of
from lodestone.operators.compounds import split_compounds


def test_sentence_chunks(spark):
    text = "One two three. " * 40
    parts = sentence_chunks_of(text, 100, 10)
    assert all(len(p) <= 100 for p in parts) and all(p.endswith(".") for p in parts)
    assert sentence_chunks_of("", 100, 10) == [] and sentence_chunks_of("x" * 250, 100, 0) == ["x" * 100, "x" * 100, "x" * 50]
    rows = spark.createDataFrame([(1, text), (2, None), (3, "short")], "id long, text string")
    got = sentence_chunks(rows, "id", size=100, overlap=10).collect()
    assert [r.chunk for r in sorted(got, key=lambda r: r.pos) if r.id == 1] == parts
    assert [r.chunk for r in got if r.id == 3] == ["short"] and not [r for r in got if r.id == 2]


def test_compounds(spark):
    entries = spark.createDataFrame([(w,) for w in ("arbets", "arbete", "rätt", "dag", "bok", "miljö", "skydd", "lag")], "entry string")
    words = spark.createDataFrame([(w,) for w in ("rättsdag", "miljöskyddslag", "dagbok", "bok", "okänd", None)], "word string")
    got = {r.word: r.parts for r in split_compounds(words, entries).collect()}
    assert got == {"rättsdag": ["rätt", "dag"], "miljöskyddslag": ["miljö", "skydd", "lag"], "dagbok": ["dag", "bok"]}
