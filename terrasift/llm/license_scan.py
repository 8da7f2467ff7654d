"""License scan by a positional rare-token index: DataFrame functions only.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased.
Base places are those where a phrase's words stand consecutively.

The method adds labels. Each template is a licence's known wording, with a key
phrase that must be there. The index maps each template word to its postings
(template, position). A counting pass over all documents gives each template
word its document frequency. Of each template's key phrase the ``rare`` words of
highest IDF are looked up in each file; each occurrence votes, through each posting, for a template
starting at (place in file - place in template); offsets with ``votes`` places
or more (all, if the phrase has fewer) are candidates, and a candidate counts if the template's key phrase
stands at its exact place. The score is the best candidate's share of its
template's IDF weight that the file holds in place (1 if a base phrase is there
and no template does better). A place of a key phrase gets a vote of each of its words
looked up, so each is verified, however many other licence words the file holds.

One pass over the texts splits each once and writes its number of words, the
template words that it holds, and, only for rows that hold some key phrase, all its
words; that test is exact. Document frequencies and places come from that table.
Everything happens inside the row, so nothing is shuffled but the word counts;
votes are sorted, so a row costs n log n in its places.

A null text is empty: no words, no labels, score 0. Repeated rows are reported
each. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.llm import _common as C
from terrasift.llm.line_dedup import LOWER, UPPER

#: Phrases of the base rule and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: (label, template, key phrase): wordings of public licences.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mit", "released under the mit license", "the mit license"),
    ("mit", "licensed under the mit license", "the mit license"),
    ("apache", "licensed under the apache license version 2 0", "apache license version"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation", "gnu general public license as published"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", "the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by", "this work is licensed under a creative commons attribution license", "creative commons attribution"),
]

_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), _SPLIT, -1), "")


def _gate(phrases: list[str]) -> str:
    return "(?i)(" + "|".join(_BETWEEN.join(p.split()) for p in phrases) + ")"


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, t, _ in templates for w in t.split()})


def _maybe(phrases: list[str]) -> Column:
    """Whether all words of some phrase are in the lower-cased text ``low``: necessary for the gate, and cheap."""
    test = F.lit(False)
    for phrase in phrases:
        every = F.lit(True)
        for w in sorted(set(phrase.split()), key=lambda w: (-len(w), w)):
            every &= F.col("low").contains(w)
        test |= every
    return test


def scanned(docs: DataFrame, templates=TEMPLATES, base=BASE) -> DataFrame:
    """Per row: doc_id, n_words, held (its template words), w (all its words, if it holds a key phrase; else empty)."""
    phrases = [*base, *[key for _, _, key in templates]]
    vocab = F.array(*[F.lit(w) for w in vocabulary(templates)])
    # lower() may turn a non-ASCII letter into an ASCII one; both are word characters, so the count is that of the text
    low = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text().alias("text"), F.lower(_text()).alias("low"))
    split = low.withColumn("every", F.split("low", _SPLIT, -1))
    ends = [F.when(F.get("every", F.lit(0)) == "", 1).otherwise(0), F.when((F.size("every") > 1) & (F.element_at("every", -1) == ""), 1).otherwise(0)]
    return split.select(
        "doc_id",
        (F.size("every") - ends[0] - ends[1]).cast("long").alias("n_words"),
        F.array_intersect("every", vocab).alias("held"),
        F.when(_maybe(phrases) & F.col("text").rlike(_gate(phrases)), words_of(F.col("text"))).otherwise(F.array().cast("array<string>")).alias("w"),
    )


def word_idf(scan: DataFrame, templates=TEMPLATES) -> dict[str, float]:
    """IDF of the template words (a bounded list) over all documents; the empty word counts the documents."""
    counts = scan.select(F.explode(F.concat("held", F.array(F.lit("")))).alias("word")).groupBy("word").count()
    found = {r["word"]: r["count"] for r in counts.collect()}
    return {w: math.log((found.get("", 0) + 1) / (found.get(w, 0) + 0.5)) for w in vocabulary(templates)}


def _places(words: str, phrase: str) -> Column:
    parts = phrase.split()
    test = " and ".join(f"get({words}, i + {k}) = '{p}'" for k, p in enumerate(parts))
    return F.expr(f"if(size({words}) >= {len(parts)}, filter(sequence(0, size({words}) - {len(parts)}), i -> {test}), array())")


def _key_place(template: str, key: str) -> int:
    t, k = template.split(), key.split()
    return next(i for i in range(len(t) - len(k) + 1) if t[i : i + len(k)] == k)


def license_scan(docs: DataFrame, templates=TEMPLATES, base=BASE, rare: int = 8, votes: int = 2) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    d = C.materialize(scanned(docs, templates, base), "licences")
    idf = word_idf(d, templates)
    # base places
    phrases = list(base)
    for k, p in enumerate(phrases):
        d = d.withColumn(f"p{k}", _places("w", p))
    every = F.concat(*[f"p{k}" for k in range(len(phrases))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(base[p])) for k, p in enumerate(phrases)]))
    d = d.withColumn("base", F.sort_array(F.array_distinct(labels))).withColumn("places", every)
    # the rarest words of each key phrase, all their places, and their votes
    posting: dict[str, list[tuple[int, int]]] = {}
    enough = []
    for t, (_, text, key) in enumerate(templates):
        own = sorted(set(key.split()), key=lambda w: (-idf[w], w))[:rare]
        first = _key_place(text, key)
        spots = [(first + p, w) for p, w in enumerate(key.split()) if w in own]
        enough.append(min(votes, len(spots)))
        for p, w in spots:
            posting.setdefault(w, []).append((t, p))
    ordered = F.array(*[F.lit(w) for w in sorted(posting)])
    postings = F.create_map(*[x for w in sorted(posting) for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in posting[w]]))])
    d = d.withColumn("rare", F.array_intersect(ordered, "w")).withColumn("enough", F.array(*[F.lit(n) for n in enough]))
    # rare and cast are bound by a one-element transform; inlined into the inner lambdas they would be made anew for each word
    spots = F.expr("get(transform(array(rare), r -> filter(transform(w, (x, i) -> struct(x as x, i as i)), s -> array_contains(r, s.x))), 0)")
    d = d.withColumn("spots", spots).withColumn("postings", postings)
    # a vote is template * 2^32 + start; sorted, a start with enough votes begins a long enough run
    d = d.withColumn(
        "cast", F.expr("sort_array(flatten(transform(spots, s -> transform(postings[s.x], q -> q.t * 4294967296L + s.i - q.p))))")
    ).drop("spots", "postings")
    t = "cast(shiftright(v + 2147483648L, 32) as int)"
    runs = f"get(transform(array(cast), c -> filter(c, (v, i) -> coalesce(get(c, i + get(enough, {t}) - 1) = v, false) and not coalesce(get(c, i - 1) = v, false))), 0)"
    start = f"transform(runs, v -> struct({t} as t, cast(v - shiftright(v + 2147483648L, 32) * 4294967296L as int) as at))"
    d = d.withColumn("runs", F.expr(runs)).drop("cast").withColumn("candidates", F.expr(start)).drop("runs")
    # mandatory key phrases at their places, and the share of the template's weight in place
    tables = F.array(
        *[
            F.struct(
                F.lit(label).alias("label"),
                F.lit(_key_place(text, key)).alias("key_at"),
                F.array(*[F.lit(x) for x in key.split()]).alias("key"),
                F.array(*[F.struct(F.lit(x).alias("x"), F.lit(float(idf[x])).alias("weight")) for x in text.split()]).alias("words"),
                F.lit(float(sum(idf[x] for x in text.split()))).alias("total"),
            )
            for label, text, key in templates
        ]
    )
    d = d.withColumn("tables", tables)
    d = d.withColumn(
        "verified",
        F.expr(
            "filter(transform(candidates, c -> struct(tables[c.t] as t, c.at as at)), c -> c.at + c.t.key_at >= 0 and "
            "slice(w, c.at + c.t.key_at + 1, size(c.t.key)) = c.t.key)"
        ),
    ).drop("tables", "candidates")
    share = F.expr(
        "array_max(transform(verified, c -> aggregate(transform(c.t.words, (x, i) -> if(c.at + i >= 0 and get(w, c.at + i) = x.x, x.weight, 0.0D)), "
        "0.0D, (a, b) -> a + b) / c.t.total))"
    )
    d = d.withColumn("found", F.expr("transform(verified, c -> c.t.label)")).withColumn("share", share)
    score = F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.size("base") > 0, 1.0).otherwise(0.0))
    join = lambda a: F.array_join(a, ",")
    return d.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        join("base").alias("base_labels"),
        join(F.sort_array(F.array_distinct(F.concat("base", "found")))).alias("labels"),
        F.least(F.lit(1.0), score).alias("score"),
    )
