"""JSON files read in byte ranges against whole parses."""

import json
import random

import pytest

from lodestone.sources import json_ranges as J


def values(rng, depth=0):
    kind = rng.random()
    text = "".join(rng.choice(['a', 'é', '"', "\\", "{", "}", "[", "]", ",", ":", "\n", " ", "漢"]) for _ in range(rng.randint(0, 12)))
    if depth > 2 or kind < 0.4:
        return text
    if kind < 0.6:
        return rng.randint(-9, 9)
    if kind < 0.8:
        return [values(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {text[:3] + str(i): values(rng, depth + 1) for i in range(rng.randint(0, 3))}


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_ranges_equal_the_whole_parse(spark, tmp_path, size):
    rng = random.Random(size)
    rows = [{"id": i, "v": values(rng), "title": "\\" * rng.randint(0, 4) + '"'} for i in range(25)]
    shapes = {
        "list.json": rows, "mixed.json": [1, "x{", rows[0], [rows[1]], None, rows[2]], "one.json": rows[3], "empty.json": [],
        "env.json": {"meta": [{"id": 900}], "note": "documents\": [{", "documents": rows[:9], "after": {"documents": [{"id": 901}]}, "tail": [{"id": 902}]},
    }
    want = {"list.json": rows, "mixed.json": [rows[0], rows[2]], "one.json": [rows[3]], "env.json": rows[:9]}
    for name, x in shapes.items():
        (tmp_path / name).write_text(json.dumps(x, ensure_ascii=name == "env.json", indent=rng.choice([None, 1])), encoding="utf-8")
    got = {}
    for r in sorted(J.record_texts(spark, str(tmp_path), size).collect(), key=lambda r: (r.file, r.range, r.pos)):
        got.setdefault(r.file, []).append(json.loads(r.text))
    assert got == want


def test_one_large_array_is_many_tasks(spark, tmp_path):
    rows = [{"id": i, "text": "x" * 90 + '"}' * (i % 3)} for i in range(20_000)]
    (tmp_path / "big.json").write_text(json.dumps({"records": rows}))
    df = J.read_json_records(spark, str(tmp_path), "id long, text string", 1 << 17)
    per = {r.range: r["count"] for r in df.groupBy("range").count().collect()}
    assert len(per) > 10 and max(per.values()) < 2500 and sum(per.values()) == 20_000
    assert df.selectExpr("sum(id) s").first().s == sum(r["id"] for r in rows)


def test_pure_scan_of_escapes():
    import numpy as np
    import pyarrow as pa

    text = ('["' + "\\\\" * 3 + '\\"' + '{", {"a": "' + "\\" * 8 + '"}]').encode()
    f = pa.BufferReader(text)
    whole = J.quotes(np.frombuffer(text, np.uint8), False)
    for cut in range(1, len(text)):
        parts = [J.quotes(np.frombuffer(text[lo:hi], np.uint8), J.starts_escaped(f, lo)) for lo, hi in ((0, cut), (cut, len(text)))]
        assert (np.concatenate(parts) == whole).all()
