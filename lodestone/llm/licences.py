"""License scans by a positional rare-token index, in DataFrame expressions alone.

Method.  Templates are word sequences of licence notices.  The index holds, for
each template, the ``rare`` words of its whole notice with the highest inverse
document frequency (counted over all documents) and their places.  Each file's
occurrences of indexed words are looked up; a posting and an occurrence give a
relative place of the template in the file, and places on which at least
``agree`` of its rare words fall together remain.  There a mandatory key phrase
must stand word for word, and at least ``least_share`` of the template's weight,
by inverse document frequency, must stand in place.  That share is the score.

Work per file is linear in its words and in candidates, and nothing is shuffled
but the counts of the templates' few words.

Defined results.  Null and empty texts have no words, no labels and score 0.
Overlapping and repeated notices all count as places; labels are distinct.
Texts of any length are read whole.  Of equally rare words the earlier in the
notice is indexed.  Columns beyond doc_id and text are never read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import UPPER_AZ

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose places are counted, and their labels.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Label, notice, mandatory key phrase within it.
TEMPLATES = (
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", "affero general public license version 3"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify and or distribute this software"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted free of charge"),
    ("mpl-2.0", "subject to the terms of the mozilla public license version 2 0", "mozilla public license"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "you may not use this file except in compliance with the license"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice", "must retain the above copyright notice this list of conditions"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "this permission notice appear in all copies"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "to deal in the software without restriction"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)


def _text(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


def _array(words) -> str:
    return f"array({', '.join(map(_text, words))})"


def words_of(column: str = "text") -> Column:
    """Words of a text after lower-casing A-Z alone."""
    lowered = F.translate(F.coalesce(F.col(column).cast("string"), F.lit("")), UPPER_AZ, UPPER_AZ.lower())
    return F.filter(F.split(lowered, SEPARATORS), lambda w: w != "")


def document_frequencies(documents: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Rows, and in how many of them each word of the (fixed) vocabulary stands."""
    found = documents.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(words_of(), F.array(*map(F.lit, vocabulary))))).alias("w"))
    counts = {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count("*").alias("n")).collect()}  # a row a word of the vocabulary
    return counts.pop("", 0), counts


def rare_places(words: list[str], idf: dict[str, float], rare: int) -> list[int]:
    """Places of a notice's rarest different words; ties go to the earlier."""
    first = {w: i for i, w in reversed(list(enumerate(words)))}
    return sorted(first.values(), key=lambda i: (-idf[words[i]], i))[:rare]


def scan(documents: DataFrame, templates=TEMPLATES, rare: int = 3, agree: int = 2, least_share: float = 0.5) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    rare: indexed words of a template.  agree: how many of them must agree on a
    relative place.  least_share: of a template's weight that must stand there.
    """
    vocabulary = sorted({w for _, notice, _ in templates for w in notice.split()})
    rows, df = document_frequencies(documents, vocabulary)
    idf = {w: math.log((rows + 1) / (df.get(w, 0) + 1)) + 1e-9 for w in vocabulary}

    literals, index = [], {}
    for n, (label, notice, key) in enumerate(templates):
        words, phrase = notice.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        places = rare_places(words, idf, rare)
        whole = sum(idf[w] for w in words)
        for i in places:
            index.setdefault(words[i], []).append((n, i))
        indexed = ", ".join(f"named_struct('w', {_text(words[i])}, 'p', {i})" for i in places)
        weights = ", ".join(f"named_struct('w', {_text(w)}, 'p', {i}, 'x', {idf[w] / whole!r}D)" for i, w in enumerate(words))
        literals.append(f"named_struct('label', {_text(label)}, 'rare', array({indexed}), 'first', {at}, 'key', {_array(phrase)}, 'weights', array({weights}))")
    posted = ", ".join(f"named_struct('w', {_text(w)}, 't', {t}, 'p', {p})" for w, places in sorted(index.items()) for t, p in places)
    marked = sorted({"license", *index})

    base = documents.select("doc_id", words_of().alias("words"))
    base = base.select("doc_id", "words", F.expr(f"filter(transform(words, (w, i) -> if(w IN ({', '.join(map(_text, marked))}), i, -1)), i -> i >= 0)").alias("marks"))
    phrases = []
    for phrase, label in BASE_PHRASES:
        *before, last = phrase.split()
        fit = " AND ".join([f"get(words, i) = {_text(last)}", *(f"get(words, i - {len(before) - k}) = {_text(w)}" for k, w in enumerate(before))])
        phrases.append(f"WHEN {fit} THEN named_struct('at', i - {len(before)}, 'label', {_text(label)})")
    base = base.withColumn("places", F.expr(f"filter(transform(marks, i -> CASE {' '.join(phrases)} END), x -> x IS NOT NULL)"))
    base = base.withColumn("found", F.expr(f"flatten(transform(marks, i -> transform(filter(array({posted}), p -> p.w = get(words, i)), p -> named_struct('t', p.t, 'at', i - p.p))))"))
    base = base.withColumn("templates", F.expr(f"array({', '.join(literals)})"))
    agreed = f"size(filter(templates[c.t].rare, r -> get(words, c.at + r.p) <=> r.w)) >= {agree}"
    verified = "c.at + templates[c.t].first >= 0 AND slice(words, greatest(c.at + templates[c.t].first, 0) + 1, size(templates[c.t].key)) = templates[c.t].key"
    weight = "aggregate(templates[c.t].weights, 0D, (s, x) -> s + if(get(words, c.at + x.p) <=> x.w, x.x, 0D))"
    base = base.withColumn("met", F.expr(f"filter(transform(filter(found, c -> {agreed} AND {verified}), c -> named_struct('t', c.t, 'share', {weight})), m -> m.share >= {least_share!r}D)"))
    score = F.expr("round(least(1D, coalesce(array_max(transform(met, m -> m.share)), 0D)), 9)")
    own = "array_distinct(transform(places, x -> x.label))"
    return base.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.size("places").cast("long").alias("n_base"),
        F.expr("array_min(transform(places, x -> cast(x.at AS bigint)))").alias("first_word"), F.expr("array_max(transform(places, x -> cast(x.at AS bigint)))").alias("last_word"),
        F.expr(f"array_join(array_sort({own}), ',')").alias("base_labels"),
        F.expr(f"array_join(array_sort(array_union({own}, transform(met, m -> templates[m.t].label))), ',')").alias("labels"), score.alias("score"),
    )
