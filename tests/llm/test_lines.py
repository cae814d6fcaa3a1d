"""Removal of shared lines against brute force, on whole small tables and on awkward rows."""

import hashlib
from collections import defaultdict

import pytest

from lodestone.llm import lines

DIR = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LAST = float("inf")


def brute(rows, least_documents=2, least_chars=10):
    """(id, lines, lines dropped, text left) of each row; a null id comes after all others."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(LAST if i is None else i)
    out = []
    for i, text in rows:
        every = (text or "").split("\n")
        own = LAST if i is None else i
        left = [x for x in every if len(key(x)) < least_chars or len(held[key(x)]) < least_documents or own == min(held[key(x)])]
        out.append((i, len(every), len(every) - len(left), "\n".join(left)))
    return sorted(out, key=repr)


AWKWARD = [
    (4, None), (5, ""), (6, "\n"), (7, "\n\n\n"), (1, "a shared line\nnine char\nown words here"), (2, "  A SHARED line\t\r\nnine char\nA shared line"), (3, "É shared line\né shared line\nown"),
    (8, "é shared line"), (9, "ten chars!"), (10, "TEN CHARS!\n"), (11, "漢字漢字漢字漢字漢字"), (12, "漢字漢字漢字漢字漢字\n漢字漢字"), (13, " a shared line "), (14, "a shared line\x0b\x0c\x1c"),
    (15, "twice in one row\ntwice in one row"), (16, "a row that comes twice"), (16, "a row that comes twice"), (17, "first of two texts\nown words here"), (17, "second of two texts\nA shared line"),
    (None, "only null ids hold this\na shared line"), (None, "only null ids hold this"), (18, "x" * 3_000_000 + "\n" + "y\n" * 200_000 + "a shared line"), (19, "x" * 3_000_000), (20, "nul \x00 inside\ntail"), (21, "NUL \x00 inside"),
]


@pytest.mark.parametrize("least_documents", [2, 3])
def test_awkward_rows(spark, least_documents):
    df = spark.createDataFrame([(i, t, "h", "g") for i, t in AWKWARD], "doc_id long, text string, h1 string, gone string").repartition(3)
    got = lines.without_shared_lines(df, least_documents).collect()
    assert all((r.own.h1, r.own.gone) == ("h", "g") for r in got)
    assert sorted(((r.own.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got), key=repr) == brute(AWKWARD, least_documents)
    cleaned = lines.drop_shared_lines(df, least_documents)
    assert cleaned.columns == df.columns and sorted(((r.doc_id, r.text) for r in cleaned.collect()), key=repr) == sorted(((i, t) for i, _, _, t in brute(AWKWARD, least_documents)), key=repr)
    assert lines.line_report(df.limit(0)).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in lines.line_report(docs).collect()), key=repr)
    assert got == sorted(((i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in want), key=repr)
    assert sum(k for _, _, k, _ in want)
