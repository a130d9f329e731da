"""Licence scans with a positional index of rare words.

Each licence notice is a template. How many documents have each of the templates' words is counted over the whole table; the
index has, for each template, its RARE words with the fewest documents (the highest IDF), and where they stand in it. A
document's places of those words vote for where the template would begin in it; places of the template's key phrases vote
alike. A template is found where most of its indexed words and all of its key phrases agree on the beginning, up to BAND
words. A document may hold any number of notices, at any place. Four base phrases give their labels wherever they stand.

Only DataFrame functions are used. Texts are read twice and never shuffled; what is shuffled are places of rare words in
documents that have enough of them. The templates are a parameter; the words whose counts come to the driver are theirs.

Defined cases: a null text is empty and has no word and no label; repeated rows count as often as they stand; ties among
words are broken by the word; an empty table gives an empty result. Other columns aren't looked at.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RARE, SHARE, BAND = 8, 0.6, 16


@dataclass(frozen=True)
class Template:
    name: str
    label: str
    text: str
    keys: tuple[str, ...]


# The phrases and labels of the contract, then notices as their licences word them.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEMPLATES = (
    Template("mit-notice", "mit", "Released under the MIT License.", ("mit license",)),
    Template(
        "mit-permission",
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    Template(
        "isc-permission",
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        ("for any purpose with or without fee is hereby granted",),
    ),
    Template(
        "bsd-conditions",
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation",
        ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce"),
    ),
    Template("apache-notice", "apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache license version 2 0",)),
    Template(
        "apache-header",
        "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
        ("you may not use this file except in compliance with the license", "unless required by applicable law or agreed to in writing"),
    ),
    Template("gpl-notice", "gpl-3", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public license version 3",)),
    Template(
        "gpl-header",
        "gpl",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ("under the terms of the gnu general public license", "published by the free software foundation"),
    ),
    Template(
        "mpl-header",
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        ("this source code form is subject to the terms of the mozilla public license",),
    ),
    Template("cc-by-nc-notice", "cc-by-nc", "Licensed under CC BY-NC 4.0.", ("cc by nc",)),
)


def template_words(text: str) -> list[str]:
    return re.findall(r"[0-9a-z]+", text.lower())


def license_words(text: Column) -> Column:
    """A text's words, A-Z in lower case. Other letters may be lowered too: no phrase or template has them. The two of which ASCII letters would come are replaced first."""
    low = F.lower(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("é")), F.lit("İ"), F.lit("é")))
    return F.array_remove(F.split(low, NOT_WORD), "")


def _spaced(phrase: str) -> str:
    """A phrase as it stands in a text of which each word has a blank on both sides."""
    return "".join(f" {w} " for w in phrase.split(" "))


def _count(part: Column) -> Column:
    """The words of such a text."""
    return ((F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))) / 2).cast("long")


def rare_words(docs: DataFrame, templates: tuple[Template, ...]) -> dict[str, list[str]]:
    """Of each template the RARE words that the fewest documents have."""
    vocabulary = sorted({w for t in templates for w in template_words(t.text)})
    there = docs.select(F.explode(F.array_intersect(F.lit(vocabulary), license_words(F.col("text")))).alias("word")).groupBy("word").count()
    n = {r["word"]: r["count"] for r in there.collect()}  # the templates' words
    return {t.name: sorted(set(template_words(t.text)), key=lambda w: (n.get(w, 0), w))[:RARE] for t in templates}


def scanned(docs: DataFrame, words: list[str], phrases: list[str], least: int) -> DataFrame:
    """docs (doc_id, text) to row_id, doc_id, n_words, n_<k>, first_<k> and last_<k> of the k-th base phrase, hits (word, at) and gaps (by key phrase: the words before each place since the last one)."""
    w = docs.select("doc_id", license_words(F.col("text")).alias("w"))
    w = w.select("doc_id", "w", F.size("w").cast("long").alias("n_words"), F.concat(F.lit(" "), F.array_join("w", "  "), F.lit(" ")).alias("j"))
    parts = lambda p: F.when(F.contains(F.col("j"), F.lit(_spaced(p))), F.split(F.col("j"), _spaced(p), -1))
    w = w.select("doc_id", "w", "n_words", *[parts(p).alias(f"p{k}") for k, p in enumerate(PHRASES)], *[parts(p).alias(f"k{k}") for k, p in enumerate(phrases)])
    base = []
    for k, p in enumerate(PHRASES):
        size = p.count(" ") + 1
        n = F.coalesce(F.size(f"p{k}") - 1, F.lit(0)).cast("long")
        base += [n.alias(f"n_{k}"), _count(F.element_at(f"p{k}", 1)).alias(f"first_{k}"), (F.col("n_words") - _count(F.element_at(f"p{k}", -1)) - size).alias(f"last_{k}")]
    hits = F.when(
        F.size(F.array_intersect(F.lit(words), F.col("w"))) >= least,
        F.filter(F.transform("w", lambda x, i: F.struct(x.alias("word"), i.cast("long").alias("at"))), lambda x: x["word"].isin(words)),
    )
    gaps = [F.transform(F.slice(f"k{k}", F.lit(1), F.size(f"k{k}") - 1), _count).alias(f"g{k}") for k in range(len(phrases))]
    return w.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "n_words", *base, hits.alias("hits"), *gaps)


def votes(scan: DataFrame, templates: tuple[Template, ...], index: dict[str, list[str]], phrases: list[str]) -> DataFrame:
    """row_id, template, key (an indexed word or a key phrase), is_phrase, begin: where the template would begin."""
    spark = scan.sparkSession
    postings = [(w, t.name, i) for t in templates for i, w in enumerate(template_words(t.text)) if w in index[t.name]]
    starts = [(p, t.name, " ".join(template_words(t.text)).split(p)[0].count(" ")) for t in templates for p in t.keys]
    table_of = lambda rows: F.broadcast(spark.createDataFrame(rows, "key string, template string, stands long"))  # noqa: E731  of the templates alone
    hits = scan.select("row_id", F.explode("hits").alias("h")).select("row_id", F.col("h.word").alias("key"), F.col("h.at").alias("at"))
    all_gaps = F.array(*[F.struct(F.lit(p).alias("key"), F.lit(p.count(" ") + 1).alias("size"), F.col(f"g{k}").alias("gaps")) for k, p in enumerate(phrases)])
    # a place's words before it: running sums of the gaps, and the phrases' own words
    each = scan.select("row_id", F.explode(F.filter(all_gaps, lambda x: x["gaps"].isNotNull())).alias("g")).select("row_id", "g.key", "g.size", F.col("g.gaps").alias("gaps"))
    sums = F.transform(F.sequence(F.lit(0), F.floor((F.size("gaps") - 1) / 1024).cast("int")), lambda b: F.aggregate(F.slice("gaps", F.lit(1), b * 1024), F.lit(0).cast("long"), lambda s, x: s + x))
    blocks = each.select("row_id", "key", "size", F.posexplode(sums).alias("b", "before"), "gaps").select("row_id", "key", "size", "b", "before", F.slice("gaps", F.col("b") * 1024 + 1, F.lit(1024)).alias("gaps"))
    own = blocks.select("row_id", "key", "size", "b", "before", F.posexplode("gaps").alias("i", "gap"), "gaps")
    at = F.col("before") + F.aggregate(F.slice("gaps", F.lit(1), F.col("i") + 1), F.lit(0).cast("long"), lambda s, x: s + x) + (F.col("b") * 1024 + F.col("i")) * F.col("size")
    places = own.select("row_id", "key", at.alias("at"))
    words = hits.join(table_of(postings), "key").select("row_id", "template", "key", F.lit(False).alias("is_phrase"), (F.col("at") - F.col("stands")).alias("begin"))
    keys = places.join(table_of(starts), "key").select("row_id", "template", "key", F.lit(True).alias("is_phrase"), (F.col("at") - F.col("stands")).alias("begin"))
    return words.unionByName(keys)


def license_scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    docs = docs.select("doc_id", "text")
    index = rare_words(docs, templates)
    need = {t.name: math.ceil(SHARE * len(index[t.name])) for t in templates}
    phrases = sorted({p for t in templates for p in t.keys})
    scan = saved(scanned(docs, sorted({w for ws in index.values() for w in ws}), phrases, min(need.values(), default=1)), "scanned")
    found = votes(scan, templates, index, phrases)
    # two grids of bands, so that beginnings that differ by half a band at most share one
    grids = F.explode(F.array(*[F.struct(F.lit(g).alias("grid"), F.floor((F.col("begin") + g * (BAND // 2)) / BAND).alias("band")) for g in range(2)]))
    banded = found.select("row_id", "template", "key", "is_phrase", grids.alias("b")).groupBy("row_id", "template", "b.grid", "b.band")
    agreed = banded.agg(F.size(F.collect_set(F.when(~F.col("is_phrase"), F.col("key")))).alias("words"), F.size(F.collect_set(F.when(F.col("is_phrase"), F.col("key")))).alias("phrases"))
    about = docs.sparkSession.createDataFrame([(t.name, t.label, len(index[t.name]), need[t.name], len(set(t.keys))) for t in templates], "template string, label string, indexed int, need int, keys int")
    verified = agreed.join(F.broadcast(about), "template").where((F.col("words") >= F.col("need")) & (F.col("phrases") == F.col("keys")))
    by_row = verified.groupBy("row_id").agg(F.collect_set("label").alias("own"), F.max(F.col("words") / F.col("indexed")).alias("share"))
    some = range(len(PHRASES))
    none = F.array().cast("array<string>")
    base = F.filter(F.array(*[F.when(F.col(f"n_{k}") > 0, label) for k, label in enumerate(PHRASES.values())]), lambda x: x.isNotNull())
    n_base = sum((F.col(f"n_{k}") for k in some), F.lit(0).cast("long"))
    out = scan.drop("hits").join(by_row, "row_id", "left").withColumn("base", F.array_sort(F.array_distinct(base)))
    return out.select(
        "doc_id", "n_words", n_base.alias("n_base"), F.least(*[F.col(f"first_{k}") for k in some]).alias("first_word"), F.greatest(*[F.col(f"last_{k}") for k in some]).alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base", F.coalesce("own", none))), ",").alias("labels"),
        F.round(F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.size("base") > 0, 0.5).otherwise(0.0)), 6).alias("score"),
    )


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


ORACLE_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
tw(template, stands, word) AS (VALUES {_values([(t.name, i, w) for t in TEMPLATES for i, w in enumerate(template_words(t.text))])}),
tk(template, phrase, stands) AS (VALUES {_values([(t.name, p, " ".join(template_words(t.text)).split(p)[0].count(" ")) for t in TEMPLATES for p in t.keys])}),
tl(template, label) AS (VALUES {_values([(t.name, t.label) for t in TEMPLATES])}),
bp(phrase, label) AS (VALUES {_values(list(PHRASES.items()))}),
e AS (SELECT id, ws, unnest(generate_series(1, len(ws))) AS i FROM d),
h AS (SELECT id, i - 1 AS pos, ws[i] AS word FROM e WHERE ws[i] IN (SELECT word FROM tw)),
n AS (SELECT word, count(DISTINCT id) AS n FROM h GROUP BY word),
x AS (SELECT template, word, count(*) OVER (PARTITION BY template) AS indexed FROM (SELECT template, word, row_number() OVER (PARTITION BY template ORDER BY coalesce(n, 0), word) AS r FROM (SELECT DISTINCT template, word FROM tw) LEFT JOIN n USING (word)) WHERE r <= {RARE}),
ph AS (SELECT DISTINCT phrase, string_split(phrase, ' ') AS ps FROM (SELECT phrase FROM tk UNION ALL SELECT phrase FROM bp)),
pl AS (SELECT id, i - 1 AS pos, phrase FROM e JOIN ph ON e.ws[i] = ps[1] WHERE e.ws[i:i + len(ps) - 1] = ps),
v AS (SELECT id, template, word AS key, false AS is_phrase, pos - stands AS b FROM h JOIN x USING (word) JOIN tw USING (template, word) UNION ALL SELECT id, template, phrase, true, pos - stands FROM pl JOIN tk USING (phrase)),
g AS (SELECT id, template, count(DISTINCT key) FILTER (WHERE NOT is_phrase) AS nw, count(DISTINCT key) FILTER (WHERE is_phrase) AS np FROM v, (SELECT unnest([0, 1]) AS grid) GROUP BY id, template, grid, floor((b + grid * {BAND // 2}) / {BAND}.0)),
k AS (SELECT template, count(*) AS keys FROM tk GROUP BY template),
y AS (SELECT DISTINCT template, indexed FROM x),
f AS (SELECT id, list(DISTINCT label) AS own, max(CAST(nw AS DOUBLE) / indexed) AS share FROM g JOIN k USING (template) JOIN y USING (template) JOIN tl USING (template) WHERE np = keys AND nw >= ceil({SHARE} * indexed) GROUP BY id),
b AS (SELECT id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS base FROM pl JOIN bp USING (phrase) GROUP BY id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(own, [])))), ',') AS labels, round(greatest(coalesce(share, 0.0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0.0 END), 6) AS score
FROM d LEFT JOIN f USING (id) LEFT JOIN b USING (id)"""
