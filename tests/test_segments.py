"""Statutes and Markdown against loops over hand-made texts."""

import re

from lodestone.operators import segments as G

LAW = "Lag (2000:1) om prov\nSFS nr: 2000:1\nDepartement/myndighet: Justitiedepartementet L6\nUtfärdad: 2000-01-01\nOmtryck: SFS 2001:5\nÄndrad:\n\n1 kap. Om lagen\n1 § Första.\nmer text\n2 a § Andra, se 3 § här.\n\n2 a kap.\nRubrik på nästa rad\n1 § Tredje.\n"


def ends(got, text):
    return [*(x.start() for x in got[1:]), len(text)][: len(got)]


def paragraphs(text):
    got = list(re.finditer(r"^(\d+[a-z]?\s*§)\s*", text, re.M))
    return [(m.group(0).strip(), text[m.start() : n].strip()) for m, n in zip(got, ends(got, text), strict=True)]


def chunks(text, number):
    if number == G.BY_ARTICLES:
        if m := re.search(r"\n\s*(Art\.\s*1)", text, re.I):
            text = text[m.start() :]
        got = list(re.finditer(r"^(Art\.\s*\d+)", text, re.M | re.I))
        return [(None, None, m.group(1).strip(), text[m.start() : n].strip()) for m, n in zip(got, ends(got, text), strict=True)]
    if m := re.search(r"\n\s*(1 kap\.|1 §)", text):
        text = text[m.start() :]
    chapters = list(re.finditer(r"^(\d+[a-z]?\s*kap\.)\s*(.*)$", text, re.M))
    if not chapters:
        return [(None, None, *p) for p in paragraphs(text)]
    return [(c.group(1).strip(), c.group(2).strip(), *p) for c, n in zip(chapters, ends(chapters, text), strict=True) for p in paragraphs(text[c.end() : n])]


def test_statutes(spark):
    laws = [(1, LAW, "2000:1"), (2, "Utan kapitel\n1 § A\n2 § B\n\n 3 § inte i början", "2000:2"), (3, "SO\nArt. 1 Ett\nart. 2 Två\n", G.BY_ARTICLES), (4, None, "2000:4"), (5, "", "2000:5"), (6, "inget att dela", "2000:6"), (7, LAW * 3, "2000:7"), (8, "1 kap. Börjar genast\n1 § x", "2000:8")]
    df = spark.createDataFrame(laws, "k int, text string, sfs_nummer string")
    got = {}
    for r in sorted(G.statute_chunks(df, "k").collect(), key=lambda r: (r.k, r.pos)):
        got.setdefault(r.k, []).append((r.kapitel, r.kapitel_rubrik, r.paragraf, r.text))
    assert got == {k: c for k, t, n in laws if (c := chunks(t or "", n))}
    head = {r.k: r.h for r in df.select("k", G.statute_header("text").alias("h")).collect()}
    assert tuple(head[1]) == ("Lag (2000:1) om prov", "2000:1", "Justitiedepartementet L6", "2000-01-01", "SFS 2001:5")
    assert tuple(head[4]) == ("", "", "", "", None)
    named = G.statute_records(G.statute_chunks(df.where("k = 1"), "k").selectExpr("*", "'RF' AS short", "'2000:1' AS nr"), "nr", "short").orderBy("pos").first()
    assert named.title == "RF 1 kap. 1 § - Regeringsformen" and named.search_text.startswith("RF 1 kap. Om lagen 1 §\n1 § Första.")


NOTE = "intro\n# Arkitektur för allt\n" + "ord " * 40 + "\n#### inte\n## Kort\nx\n### 2020-01-02\n" + "dag " * 40 + "\n### 7. **Titel** ***\n" + "bevis " * 30 + "\nKör: så Här\n\n```sh\n" + "kommando " * 10 + "\n```\n\n```sh\nkort\n```\n"


def test_blocks(spark):
    df = spark.createDataFrame([(1, NOTE), (2, None), (3, ""), (4, "# \n"), (5, NOTE * 50)], "k int, text string")
    got = {}
    for r in sorted(G.blocks(df, "k").collect(), key=lambda r: (r.k, r.kind, r.pos)):
        got.setdefault((r.k, r.kind), []).append((r.header, r.body))
    assert set(k for k, _ in got) == {1, 5} and all(len(got[5, kind]) >= 50 * len(v) - 1 for (k, kind), v in got.items() if k == 1)
    assert [h for h, _ in got[1, "section"]] == ["Arkitektur för allt", "2020-01-02", "7. **Titel** ***"]
    assert got[1, "code"] == [("Visa hur man så här", "```sh\n" + "kommando " * 10 + "\n```")]
    assert [h for h, _ in got[1, "timeline"]] == ["2020-01-02"] and [h for h, _ in got[1, "evidence"]] == ["#7: Titel"]
    asked = [r.question for r in G.section_questions(G.blocks(df.where("k = 1"), "k")).orderBy("pos").collect()]
    assert asked == ["Förklara arkitekturen för Arkitektur för allt i systemet", "Vad är 2020-01-02?", "Vad är 7. **Titel** ***?"]
