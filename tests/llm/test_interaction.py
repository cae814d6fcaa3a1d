"""The audit of filters against brute force over all orders."""

import re
from itertools import permutations

from lodestone.llm import interaction as audit

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def mask_of(text, doc, least):
    words = BLANK.findall(text)
    fails = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)), doc > least)
    return {f for f, x in zip("ABCDE", fails, strict=True) if x}


def brute(docs, labels):
    last = lambda i: float("inf") if i is None else i
    least = {}
    for i, text, _ in docs:
        least[text or ""] = min(least.get(text or "", float("inf")), last(i))
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    rows = [(i, lang or "", mask_of(text or "", last(i), least[text or ""])) for i, text, lang in docs]
    out = {}
    for part in {p for _, p, _ in rows}:
        mine = [(i, m) for i, p, m in rows if p == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                removed = [(i, m) for i, m in left if f in m]
                left = [(i, m) for i, m in left if f not in m]
                failing = sum(f in m for _, m in mine)
                out[part, "".join(order), step] = [len(left), len(removed), failing - len(removed), sum(m == {f} for _, m in mine), sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed)]
    worth = {}
    for (part, order, step), v in out.items():
        worth[part, order[step - 1]] = worth.get((part, order[step - 1]), 0) + v[1]
    return sorted((p, o, s, *v, worth[p, o[s - 1]]) for (p, o, s), v in out.items())


def test_ranks_and_intervals():
    assert [audit.lehmer_rank(o) for o in audit.ORDERS] == list(range(120))
    for mask in range(1, 32):
        removed = [None] * 120
        for step, low, high in audit.removal_intervals(mask):
            assert removed[low:high] == [None] * (high - low)
            removed[low:high] = [step] * (high - low)
        assert removed == [next(s for s, f in enumerate(o, 1) if mask >> "ABCDE".index(f) & 1) for o in audit.ORDERS]


def test_awkward_rows(spark):
    long = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", " \t\n", long, long, long + " &", "WORD " * 300, "a b " * 150, "É" * 50 + "ABC", "AB" + "x" * 64, "AB" + "x" * 65, long.upper(), " ".join(f"w{i // 2}" for i in range(400)), " ".join(f"w{i // 2}" for i in range(398)) + " w0 w0 w0", "\x1c".join(long.split()), "word " * 500_000]
    docs = [(i, t, lang) for i, (t, lang) in enumerate(zip(texts, ["en", None, "", "en", "fr"] * 4, strict=False))]
    docs += [docs[3], (None, long, "en"), (None, long, None), (None, "only here", "zz"), (None, "only here", "zz"), (20, None, "fr"), (0, "another text of id 0", "en")]
    labels = [(3, 1, 0), (3, 0, 1), (4, 1, 1), (None, 1, 1), (5, None, None), (6, 0, 1), (0, 1, None), (99, 1, 1)]
    d = spark.createDataFrame([(*r, "m", 3) for r in docs], "doc_id long, text string, lang string, mask string, least int").repartition(3)
    got = audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert sorted(map(tuple, got)) == brute(docs, labels)
    assert audit.audit(d, spark.createDataFrame([], "doc_id long, quality int, toxic int")).where("good_lost + toxic_lost > 0").count() == 0
    assert audit.audit(d.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0
