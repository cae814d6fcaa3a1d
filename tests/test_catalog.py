"""Every registered query against its SQL, on the smallest tables."""

import math
import re

import duckdb
import pandas as pd
import pytest

from lodestone.functions import text
from lodestone.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return int(v) if float(v) == int(v) else float(v)
    return pd.Timestamp(v).tz_localize(None).isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    r = duck.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(x[names.index(c)]) for c in columns) for x in r.fetchall()), key=repr)


def test_whole_tables(spark):
    """The queries beside i55, i38 and d16 leave out no document; all 13 terms are corrected in order."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for name in ("i55b_stable_id_all_languages", "i38b_all_terms"):
        assert catalog.queries()[name](spark, DIR).count() == docs.count()
    assert catalog.queries()["d16b_bm25_of_listed"](spark, DIR).where("doc_id % 100 <> 0").count() > 0
    texts = [f"{t} x{t} {t.upper()}, å{t} {t}_ ({t})" for t, *_ in text.TERM_CORRECTIONS] + [" ".join(t for t, *_ in text.TERM_CORRECTIONS), "Jämställdhetsombudsmannen och PUL.", "", "none", None]
    got = text.correct_terms(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect()
    for r in got:
        fixed, n, found = texts[r.i], 0, []
        for term, corrected, confidence in text.TERM_CORRECTIONS if fixed else ():
            fixed, k = re.subn(rf"\b{term}\b", corrected, fixed, flags=re.IGNORECASE)
            n, found = n + k, found + [confidence] * (k > 0)
        assert (r.text, r.n, r.terms) == (fixed, n, len(found))
        assert r.confidence == pytest.approx(sum(found) / len(found) if found else 1.0)
