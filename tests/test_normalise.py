"""Records of six formats and documents of two schemas against plain loops."""

import json
import re

from lodestone.sources import normalise as N

BAD = {"mods": ("universitet", "skolan", "institution"), "swepub": ("universitet", "skolan", "institution", "fakultet")}


def authors(record, f):
    out = []
    for a in record.get(f.authors_at) if isinstance(record.get(f.authors_at), list) else []:
        if f.authors == "mods" and isinstance(a, dict) and a.get("role") == "aut":
            out.append(a.get("name", ""))
        elif f.authors == "pubmed" and isinstance(a, dict) and a.get("last_name"):
            out.append(f"{a.get('fore_name') or a.get('initials') or ''} {a['last_name']}".strip())
        elif isinstance(a, str) and not any(w in a.lower() for w in BAD.get(f.authors, ())):
            out.append(a.split(" 19")[0].strip() if f.authors == "swepub" else a)
    return out[:20]


def loop(record, name, code):
    f = N.FORMATS.get(name)
    if f is None or not isinstance(record, dict):
        return None
    raw = record.get(f.identifier) or ""
    listed = f.authors == "oai_dc"
    title = (record.get(f.title) or [""])[0] if listed else record.get(f.title) or ""
    doc = f.prefix + (raw if f.prefix == "pubmed_" else raw.split(":")[-1])
    if not title or doc.endswith("_"):
        return None
    abstract = (record.get(f.abstract) or [None])[0] if listed else record.get(f.abstract)
    abstract = re.sub(r"<[^>]+>", "", abstract)[:5000] if abstract is not None else None
    year = next((d[:4] for d in record.get("dates", []) if isinstance(d, str) and len(d) >= 4), None) if listed else ((record.get("datestamp") or "")[:4] or None) if f.authors == "mods" else record.get(f.year)
    subjects = record.get("subjects")
    return (doc, f"diva_{code}", title[:1000], authors(record, f), abstract, year, record.get("genre") or record.get("type"), [s for s in subjects if isinstance(s, str)][:20] if isinstance(subjects, list) else [], raw)


RECORDS = [
    ("pubmed", {"pmid": "77", "title": "T" * 1200, "authors": [{"last_name": "Ek", "fore_name": "Eva"}, {"last_name": "Al", "initials": "B"}, {"fore_name": "none"}, "Plain Name", 5, None], "abstract": "<b>x</b> y", "pub_year": "2001", "subjects": ["a", 1, "b"]}),
    ("mods", {"identifier": "oai:gu:12", "title": "M", "names": [{"name": "A", "role": "aut"}, {"name": "B", "role": "edt"}, "Göteborgs universitet", "C D", {"role": "aut"}], "datestamp": "2020-05-06", "genre": "", "type": "article", "subjects": "none"}),
    ("swepub", {"id": "x:y:9", "title": "S", "authors": ["Per 1950-", "Tekniska fakulteten", " Ann ", {"name": "no"}] + [f"n{i}" for i in range(30)], "year": "1999", "abstract": "z" * 6000}),
    ("swepub_nested", {"oai_identifier": "plain", "title": "N", "authors": [], "year": None}), ("oai_dc", {"identifier": "c:1", "titles": ["First", "Second"], "creators": ["X", 3, "Y"], "descriptions": ["<i>d</i>"], "dates": [19, "99", "2003-01"]}),
    ("swepub_lnu", {"oai_id": "l:2", "title": "L"}), ("mods", {"identifier": "a:", "title": "no id"}), ("mods", {"identifier": "a:1", "title": ""}), ("oai_dc", {"identifier": "c:3", "titles": []}), ("other", {"id": "1", "title": "T"}), ("pubmed", {}), ("pubmed", [1]),
]


def test_records_equal_a_loop(spark):
    rows = [(i, json.dumps(r, ensure_ascii=False), f, "gu") for i, (f, r) in enumerate(RECORDS)] + [(90, "not json {", "mods", "gu"), (91, None, "mods", "gu"), (92, "null", "mods", "gu")]
    df = spark.createDataFrame(rows, "i int, record string, format string, source_code string")
    got = {r.i: tuple(r)[1:] for r in N.normalised(df).collect()}
    want = {i: w for i, (f, r) in enumerate(RECORDS) if (w := loop(r, f, "gu"))}
    assert got == want and len(want) == 6
    assert {r.i for r in N.normalised(df.selectExpr("i", "try_parse_json(record) AS record", "format", "source_code")).collect()} == set(want)


def test_documents_of_two_schemas(spark):
    docs = [
        {"title": "A", "description": "d", "creators": ["x", "y"] * 4, "date": "2001", "language": "sv", "identifiers": ["http://1", "http://2"], "oai_id": "o1", "subjects": ["s"] * 12},
        {"title": "B", "abstract": "ab", "authors": [{"given": "Eva", "family": "Ek"}, {"family": "Al"}, "Plain", {}], "date_issued": "2002", "identifiers": {"url": "http://u"}, "identifier": "i2"},
        {"title": "C", "status": "deleted"}, {"title": ""}, {"description": "none"}, {"title": "D", "status": "ok", "identifiers": []},
    ]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(9, None), (10, "[]")], "i int, record string")
    got = {r.i: r for r in N.documents_of(df).collect()}
    assert set(got) == {0, 1, 5}
    assert (got[0].creators, got[0].url, got[0].oai_id, len(got[0].subjects), got[0].date) == (["x", "y", "x", "y", "x"], "http://1", "o1", 10, "2001")
    assert (got[1].creators, got[1].description, got[1].date, got[1].url, got[1].oai_id) == (["Eva Ek", "Al", "Plain"], "ab", "2002", "http://u", "i2")
    assert (got[5].url, got[5].creators, got[5].language) == ("", [], "")
