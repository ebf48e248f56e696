"""License scans: an exact set-similarity join of text blocks with license templates, DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, folded, written

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases whose words must stand consecutively, and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Opening sentences of well-known licenses and notices, and their labels.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
}

THRESHOLD = 80  # per cent of a template's distinct words
BLOCK, STEP = 64, 32  # words; a template of up to 33 words lies wholly in some block
SPAN = 2048  # words of a text that are looked at together, a multiple of STEP


def _quoted(words) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def _ints(values) -> str:
    return "CAST(array(" + ", ".join(map(str, values)) + ") AS ARRAY<INT>)"


def _bound(value: str, name: str, body: str) -> str:
    """body with value bound to a name, so that it isn't computed for each use."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def need(size: int, per_cent: int = THRESHOLD) -> int:
    return -(-size * per_cent // 100)


def words_of(text: str) -> list[str]:
    return re.findall(WORDS, text.translate(str.maketrans(UPPER, LOWER)))


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = BASE) -> DataFrame:
    """License phrases and license templates (text to label) in every whole text of docs (doc_id, text).

    Base: every place where the words of a phrase stand consecutively. Method: blocks of 64 words, starting every 32, are
    joined with the templates where a block holds at least 80 per cent of a template's distinct words. The words of templates and
    phrases get one global order, rarest first, by the number of documents that hold them. A block can only reach
    the threshold if it shares a word of the template's prefix (its n - need + 1 rarest), has need words
    of that vocabulary, and if the first word they share leaves need on both sides; what passes is counted exactly. Templates are indexed by
    their prefix words, and only blocks around such a word are looked at. The phrases take the same
    prefix filter at 100 per cent: only spans that hold a phrase's rarest word are searched for it.

    Each text is read once; only the places of the vocabulary's words, by spans of 2048 words, are written to the shared folder and
    looked at again. The templates are literals of the plan, so no text is shuffled. ValueError: a template of more than 33 words, which no
    block need hold whole, one without words, or a phrase of more than 64.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best containment that meets the threshold; 1.0
    for a phrase, else 0.0). Null and empty texts have no words and empty labels; long texts are read whole; repeated rows give repeated rows; an empty
    table gives none; other columns are ignored.
    """
    own = [(words_of(t), label) for t, label in templates.items()]
    said = [(words_of(p), label) for p, label in phrases.items()]
    if any(not 0 < len(w) <= BLOCK - STEP + 1 for w, _ in own) or any(not 0 < len(w) <= BLOCK for w, _ in said):
        raise ValueError(f"a template has 1 to {BLOCK - STEP + 1} words, a phrase 1 to {BLOCK}")
    vocabulary = sorted({w for words, _ in own + said for w in words})
    known = f"w IN ({', '.join(f"'{w}'" for w in vocabulary)})"
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_extract_all(folded("text"), F.lit(WORDS), F.lit(0)).alias("words"))
    at = f"filter(transform(part, (w, i) -> IF({known}, i, -1)), i -> i >= 0)"
    span = _bound(f"slice(words, {SPAN} * c + 1, {SPAN + BLOCK})", "part", f"named_struct('at', {at}, 'word', filter(part, w -> {known}))")
    spans = f"transform(sequence(0, greatest(size(words) - 1, 0) div {SPAN}), c -> {span})"
    found = written(words.select("doc_id", F.size("words").cast("long").alias("n_words"), F.expr(spans).alias("spans")), "license-words")

    counts = found.select(F.explode(F.expr("array_distinct(flatten(transform(spans, s -> s.word)))")).alias("word")).groupBy("word").count()
    seen = {r["word"]: r["count"] for r in counts.collect()}  # one row for each word of the vocabulary at most
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}

    places = []
    for words, label in said:
        same = " AND ".join(f"s.word[j + {k}] = '{w}' AND s.at[j + {k}] = s.at[j] + {k}" for k, w in sorted(enumerate(words), key=lambda x: rank[x[1]]))
        rare = min(words, key=rank.get)
        starts = f"IF(size(s.at) >= {len(words)} AND array_contains(s.word, '{rare}'), filter(sequence(0, size(s.at) - {len(words)}), j -> s.at[j] < {SPAN} AND {same}), CAST(array() AS ARRAY<INT>))"
        places.append(F.expr(f"flatten(transform(spans, (s, c) -> transform({starts}, j -> named_struct('at', {SPAN} * c + s.at[j], 'label', '{label}'))))"))
    found = found.withColumn("places", F.concat(*places))

    built, by_prefix = [], [[] for _ in order]
    for k, (words, label) in enumerate(own):
        ranks = sorted({rank[w] for w in words})
        first = ranks[: len(ranks) - need(len(ranks)) + 1]
        for r in first:
            by_prefix[r].append(k)
        built.append(f"named_struct('label', '{label}', 'words', {_ints(ranks)}, 'prefix', {_ints(first)}, 'need', {need(len(ranks))})")
    prefixes = [w for w, ks in zip(order, by_prefix, strict=True) if ks]
    library, index = "array(" + ", ".join(built) + ")", "array(" + ", ".join(map(_ints, by_prefix)) + ")"
    numbers = "map(" + ", ".join(f"'{w}', {i}" for w, i in rank.items()) + ")"
    last = f"greatest(n_words - {BLOCK - STEP + 1}, 0) div {STEP}"  # of the text's blocks
    near = f"filter(sequence(0, size(s.at) - 1), j -> s.word[j] IN ({', '.join(f"'{w}'" for w in prefixes)}))"
    starts = f"array_distinct(flatten(transform({near}, j -> array(s.at[j] div {STEP} - 1, s.at[j] div {STEP}))))"
    starts = f"filter({starts}, k -> k >= 0 AND k < {SPAN // STEP} AND {SPAN // STEP} * c + k <= {last})"
    block = f"array_sort(array_distinct(transform(filter(sequence(0, size(s.at) - 1), j -> s.at[j] >= {STEP} * k AND s.at[j] < {STEP} * k + {BLOCK}), j -> element_at({numbers}, s.word[j]))))"
    # length and position, then the exact count
    first = "array_min(array_intersect(b, t.prefix))"
    ahead = f"1 + least(size(t.words) - array_position(t.words, {first}), size(b) - array_position(b, {first})) >= t.need"
    reached = f"filter(transform(array_distinct(flatten(transform(b, r -> {index}[r]))), i -> {library}[i]), t -> size(b) >= t.need AND {ahead})"
    hits = f"filter(transform({reached}, t -> named_struct('label', t.label, 'need', t.need, 'n', size(t.words), 'shared', size(array_intersect(b, t.words)))), m -> m.shared >= m.need)"
    matches = f"flatten(transform(spans, (s, c) -> IF(arrays_overlap(s.word, {_quoted(prefixes)}), flatten(transform({starts}, k -> {_bound(block, 'b', hits)})), CAST(array() AS ARRAY<STRUCT<label: STRING, need: INT, n: INT, shared: INT>>))))"
    found = found.withColumn("matches", F.expr(matches))
    base = "array_distinct(transform(places, p -> p.label))"
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.expr("array_min(transform(places, p -> p.at))").cast("long").alias("first_word"), F.expr("array_max(transform(places, p -> p.at))").cast("long").alias("last_word"),
        F.expr(f"array_join(array_sort({base}), ',')").alias("base_labels"),
        F.expr(f"array_join(array_sort(array_union({base}, transform(matches, m -> m.label))), ',')").alias("labels"),
        F.expr("CASE WHEN size(places) > 0 THEN 1.0D ELSE coalesce(array_max(transform(matches, m -> CAST(m.shared AS DOUBLE) / m.n)), 0.0D) END").alias("score"),
    )


def oracle() -> str:
    """The same rows in DuckDB, by comparing every block with every template."""
    base = ", ".join(f"('{p}', '{label}')" for p, label in BASE.items())
    own = ", ".join(f"('{t}', '{label}')" for t, label in TEMPLATES.items())
    return f"""
    WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
    phrases AS (SELECT string_split(p, ' ') AS p, label FROM (VALUES {base}) v(p, label)),
    places AS (SELECT doc_id, label, i - 1 AS pos FROM w, phrases, LATERAL (SELECT unnest(range(1, greatest(len(words) - len(p) + 2, 1))) AS i) WHERE list_contains(words, p[1]) AND words[i:i + len(p) - 1] = p),
    templates AS (SELECT label, list_distinct(string_split(t, ' ')) AS t FROM (VALUES {own}) v(t, label)),
    blocks AS (SELECT doc_id, words[{STEP} * k + 1:{STEP} * k + {BLOCK}] AS b FROM w, LATERAL (SELECT unnest(range(0, greatest(len(words) - {BLOCK} + {STEP} - 1, 0) // {STEP} + 1)) AS k)),
    matches AS (SELECT doc_id, label, len(list_intersect(b, t)) AS shared, len(t) AS n FROM blocks, templates),
    hits AS (SELECT doc_id, label, shared::DOUBLE / n AS score FROM matches WHERE 100 * shared >= {THRESHOLD} * n),
    p AS (SELECT doc_id, count(*) AS n, min(pos) AS a, max(pos) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY doc_id),
    h AS (SELECT doc_id, max(score) AS score FROM hits GROUP BY doc_id),
    l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM places UNION ALL SELECT doc_id, label FROM hits) GROUP BY doc_id)
    SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(p.n, 0)::BIGINT AS n_base, p.a::BIGINT AS first_word, p.b::BIGINT AS last_word, coalesce(p.labels, '') AS base_labels,
      coalesce(l.labels, '') AS labels, CASE WHEN p.n > 0 THEN 1.0 ELSE coalesce(h.score, 0.0) END::DOUBLE AS score
    FROM w LEFT JOIN p USING (doc_id) LEFT JOIN h USING (doc_id) LEFT JOIN l USING (doc_id)"""
