"""Licence scan: TF-IDF cosine of headers and whole files to templates, inherited from the nearest directory above.

Headers are compared passage by passage with one-sentence templates, whole files with full licence texts. A passage or
file is compared in full unless a bound shows that it can't reach the least cosine: of a template's words the rarest that make
up more than the rest allows are its keys, and what has none of them has too little of the template.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table, take

#: Licence to the wording of its usual headers and first lines.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.", "Licensed under the terms of the MIT License.", "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU GPL version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU GPL version 3.",
        "This program is free software: you can redistribute it under the terms of the GNU General Public License",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.",),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.",),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted", "Licensed under the BSD 3-Clause License."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",),
    "CC-BY-4.0": ("Licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, all rights are waived under CC0 1.0.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "ISC": ("Permission to use, copy, modify, and distribute this software for any purpose is hereby granted",),
}
#: Least cosine of a match; share of a text's words in matched passages that makes it a licence file.
COSINE, FILE_SHARE = 0.75, 0.2
_SPLIT = r"[^\p{L}\p{N}]+"
#: What names a licence exactly.
_SPDX = r"(?i)SPDX-License-Identifier:[ \t]*([a-z0-9+-]+(?:[.][a-z0-9+-]+)*)"


def words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


#: Kind (header or file), licence, number, and the number of times each word occurs.
FILES = {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "templates").glob("*.txt"))}
COUNTED = [("header", name, k, Counter(words(t))) for name, lines in sorted(TEMPLATES.items()) for k, t in enumerate(lines)] + [("file", name, 0, Counter(words(t))) for name, t in FILES.items()]
VOCABULARY = sorted({w for *_, c in COUNTED for w in c})


def _words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), _SPLIT), lambda w: w != "")


def _list(ws) -> Column:
    return F.split(F.lit(" ".join(ws)), " ") if ws else F.array().cast("array<string>")


def keys(idf: dict[str, float], kind: str, cosine: float) -> tuple[list[str], int]:
    """Words of which whatever reaches the cosine to a template of the kind has one at least, and the fewest of the templates' words it has.

    A cosine is at most the norm of the shared words over the template's norm. So words whose squares make up more than
    1 - cosine**2 can't all be missing, and the largest squares that make up cosine**2 are the fewest that suffice."""
    out, least = set(), math.inf
    for k, _, _, c in COUNTED:
        if k != kind:
            continue
        square = {w: (n * idf[w]) ** 2 for w, n in c.items()}
        total, got = sum(square.values()), 0.0
        for w in sorted(square, key=lambda w: (-idf[w], w)):
            if got > (1 - (cosine - 1e-5) ** 2) * total:
                break
            got += square[w]
            out.add(w)
        got, few = 0.0, 0
        for x in sorted(square.values(), reverse=True):
            if got >= (cosine - 1e-5) ** 2 * total:
                break
            got, few = got + x, few + 1
        least = min(least, few)
    return sorted(out), int(least)


def _passages(text: Column) -> Column:
    """(form, s): the sentences of each line; and the sentences that run across lines, up to an empty one."""
    split = lambda c, form: F.transform(F.split(F.regexp_replace(c, r"([.!?])[ \t]+", "$1\n"), "\n"), lambda s: F.struct(F.lit(form).alias("form"), s.alias("s")))
    joined = F.translate(F.regexp_replace(F.regexp_replace(text, "\r", ""), r"\n[^\p{L}\p{N}\n]*(?=\n)", ". "), "\n", " ")
    return F.concat(split(text, "line"), split(joined, "run"))


def matches(docs: DataFrame, cosine: float = COSINE) -> DataFrame:
    """What matches in each document: doc_id, h (of its text), form (line, run or file), k (which passage), license, cosine, n (words of it).

    Inverse document frequencies of all words are of all documents: ln((1 + N) / (1 + df)) + 1. The best template counts;
    of equals the first by name.
    """
    d = take(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    spark = d.sparkSession
    df = stored(d.select(F.explode(F.array_distinct(_words(F.col("text")))).alias("w")).groupBy("w").agg(F.count("*").alias("df")))
    n = d.count()
    known = {r.w: r.df for r in df.filter(F.array_contains(_list(VOCABULARY), F.col("w"))).collect()}  # the templates' words, whatever the corpus
    idf = {w: math.log((1 + n) / (1 + known.get(w, 0))) + 1 for w in VOCABULARY}
    t = []
    for kind, name, k, c in COUNTED:
        norm = math.sqrt(sum((m * idf[w]) ** 2 for w, m in c.items()))
        t += [(kind, name, k, w, m * idf[w] / norm) for w, m in c.items()]
    t = spark.createDataFrame(t, "kind string, license string, t int, w string, y double")
    (header, _), (whole, fewest) = (keys(idf, k, cosine) for k in ("header", "file"))
    ws = _words(F.col("text"))
    hashed = d.withColumn("h", F.sha2("text", 256))
    passages = (
        hashed.filter(F.arrays_overlap(ws, _list(header))).dropDuplicates(["doc_id", "h"])
        .select("doc_id", "h", F.posexplode(_passages(F.col("text"))).alias("k", "p"))
        .select("doc_id", "h", "p.form", F.col("k").cast("long").alias("k"), _words(F.col("p.s")).alias("ws")).filter(F.arrays_overlap("ws", _list(header)))
    )
    vocabulary = sorted({w for kind, _, _, c in COUNTED if kind == "file" for w in c})
    files = hashed.filter(F.arrays_overlap(ws, _list(whole)) & (F.size(F.array_intersect(ws, _list(vocabulary))) >= fewest)).dropDuplicates(["doc_id", "h"])
    units = passages.unionByName(files.select("doc_id", "h", F.lit("file").alias("form"), F.lit(0).cast("long").alias("k"), ws.alias("ws")))
    at = ["doc_id", "h", "form", "k"]
    tf = units.select(*at, F.size("ws").cast("long").alias("n"), F.explode("ws").alias("w")).groupBy(*at, "n", "w").agg(F.count("*").alias("tf"))
    x = tf.join(df, "w").select(*at, "n", "w", (F.col("tf") * (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1)).alias("x"), F.when(F.col("form") == "file", "file").otherwise("header").alias("kind"))
    # per unit first, so that its words go to one place once
    own = x.groupBy(*at, "n", "kind").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("own"), F.collect_list(F.struct("w", "x")).alias("xs"))
    scored = (
        own.select(*at, "n", "own", "kind", F.inline("xs")).join(F.broadcast(t), ["kind", "w"]).groupBy(*at, "n", "own", "license", "t")
        .agg(F.round(F.sum(F.col("x") * F.col("y")) / F.col("own"), 6).alias("cosine")).filter(F.col("cosine") >= cosine)
    )
    best = scored.groupBy(*at, "n").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b"))
    return best.select(*at, "n", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"))


def scan_licenses(files: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row for each row of files: doc_id, path, license, cosine, how ("own", "inherited" or null), licensed_by.

    Needs doc_id, path and text; extra columns are dropped. A file's own licence is that of its best passage, or of its
    whole text against the full licence texts (of equals the first by name); the first SPDX-License-Identifier of a text is
    taken as it stands, with cosine 1. A licence file (one whose whole text matches, or with FILE_SHARE or more of its words in
    matched passages) gives its licence to the files at and below its directory that have none; the nearest directory above wins,
    in it the licence file of greatest cosine, then least doc_id. licensed_by is the doc_id of the licence's file. Texts are read
    whole. Null or empty texts have no licence of their own; a file without a path inherits nothing and gives nothing; null doc_ids
    and repeated rows stay. No rows give no rows.
    """
    f = take(files, "doc_id", "path", "text").withColumn("text", F.coalesce("text", F.lit("")))
    m = stored(matches(f, cosine))
    sums = [F.coalesce(F.sum(F.when(F.col("form") == form, F.col("n"))), F.lit(0)) for form in ("line", "run")]
    own = m.groupBy("doc_id", "h").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b"), F.greatest(*sums).alias("matched"), F.max(F.col("form") == "file").alias("whole"))
    own = own.select(F.col("doc_id").alias("d"), F.col("h").alias("hh"), "b", "matched", "whole")
    tag = F.regexp_extract("text", _SPDX, 1)
    spdx = F.when(tag != "", F.struct(F.lit(-1.0).alias("c"), tag.alias("license")))
    rows = f.select("doc_id", "path", F.sha2("text", 256).alias("h"), F.size(_words(F.col("text"))).cast("long").alias("n"), spdx.alias("spdx"))
    rows = rows.join(own, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("hh")), "left").withColumn("b", F.coalesce("spdx", "b"))
    rows = rows.select("doc_id", "path", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"), (F.coalesce("whole", F.lit(False)) | (F.coalesce("matched", F.lit(0)) >= F.lit(FILE_SHARE) * F.col("n")) & F.col("b").isNotNull()).alias("is_file"))
    rows = stored(rows)
    folder = F.regexp_replace("path", "/[^/]*$", "")
    given = (
        rows.filter("is_file and path is not null").select(folder.alias("dir"), F.struct((-F.col("cosine")).alias("c"), "doc_id", "license").alias("g")).groupBy("dir").agg(F.min("g").alias("g"))
    )
    # each directory once: its own name and those above it, joined by path
    dirs = rows.filter("license is null and path is not null").select(folder.alias("dir")).distinct()
    above = dirs.select("dir", F.split("dir", "/").alias("p")).select("dir", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice("p", 1, i), "/"))).alias("depth", "up"))
    nearest = above.join(given.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by("g", "depth").alias("g"))
    out = rows.withColumn("dir", F.when(F.col("license").isNull(), folder)).join(nearest, "dir", "left")
    return out.select(
        "doc_id",
        "path",
        F.coalesce("license", "g.license").alias("license"),
        F.coalesce("cosine", -F.col("g.c")).alias("cosine"),
        F.when(F.col("license").isNotNull(), "own").when(F.col("g").isNotNull(), "inherited").alias("how"),
        F.when(F.col("license").isNotNull(), F.col("doc_id")).otherwise(F.col("g.doc_id")).alias("licensed_by"),
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: /<source>/<lang>/<doc_id by thousands>/<doc_id>."""
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/"), F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")), F.lit("/"), F.floor(F.col("doc_id") / 1000).cast("string"), F.lit("/"), F.col("doc_id").cast("string"))
    return scan_licenses(d.select("doc_id", path.alias("path"), "text"))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_T = ", ".join(f"({_q(kind)}, {_q(name)}, {k}, {_q(w)}, {m})" for kind, name, k, c in COUNTED for w, m in c.items())
SQL = f"""
WITH f AS (SELECT doc_id, '/' || coalesce(source, '') || '/' || coalesce(lang, '') || '/' || (doc_id // 1000)::VARCHAR || '/' || doc_id::VARCHAR AS path,
                  coalesce(text, '') AS text FROM documents),
fw AS (SELECT doc_id, path, text, list_filter(regexp_split_to_array(lower(text), '{_SPLIT}'), lambda w: w <> '') AS ws FROM f),
n AS (SELECT count(*) AS n FROM f),
df AS (SELECT w, count(*) AS df FROM (SELECT unnest(list_distinct(ws)) AS w FROM fw) GROUP BY w),
tt(kind, license, t, w, m) AS (VALUES {_T}),
y AS (SELECT kind, license, t, tt.w, m * (ln((1 + n) / (1 + coalesce(df, 0))) + 1) AS y FROM tt LEFT JOIN df USING (w), n),
tn AS (SELECT kind, license, t, sqrt(sum(y * y)) AS norm FROM y GROUP BY ALL),
l AS (SELECT doc_id, form, unnest(range(len(s))) AS k, unnest(s) AS s
      FROM (SELECT doc_id, form, string_split(regexp_replace(x, '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10)) AS s
            FROM (SELECT doc_id, 'line' AS form, text AS x FROM f UNION ALL
                  SELECT doc_id, 'run', replace(regexp_replace(replace(text, chr(13), ''), '\\n([^\\p{{L}}\\p{{N}}\\n]*\\n)+', '. ', 'g'), chr(10), ' ') FROM f))),
u AS (SELECT doc_id, form, k, 'header' AS kind, list_filter(regexp_split_to_array(lower(s), '{_SPLIT}'), lambda w: w <> '') AS ws FROM l UNION ALL SELECT doc_id, 'file', 0, 'file', ws FROM fw),
tf AS (SELECT doc_id, form, k, kind, n, w, count(*) AS tf FROM (SELECT doc_id, form, k, kind, len(ws) AS n, unnest(ws) AS w FROM u) GROUP BY ALL),
x AS (SELECT doc_id, form, k, kind, tf.n, w, tf * (ln((1 + n.n) / (1 + df)) + 1) AS x FROM tf JOIN df USING (w), n),
xn AS (SELECT doc_id, form, k, sqrt(sum(x * x)) AS own FROM x GROUP BY ALL),
sc AS (SELECT doc_id, form, k, x.n, license, t, round(sum(x * y) / any_value(own) / any_value(norm), 6) AS cosine
       FROM x JOIN y USING (kind, w) JOIN tn USING (kind, license, t) JOIN xn USING (doc_id, form, k) GROUP BY ALL),
m AS (SELECT doc_id, form, k, n, license, cosine FROM sc WHERE cosine >= {COSINE}
      QUALIFY row_number() OVER (PARTITION BY doc_id, form, k ORDER BY cosine DESC, license) = 1),
o AS (SELECT doc_id, arg_min(license, (-cosine, license)) AS license, max(cosine) AS cosine,
             greatest(sum(n) FILTER (form = 'line'), sum(n) FILTER (form = 'run')) AS matched, bool_or(form = 'file') AS whole FROM m GROUP BY doc_id),
s AS (SELECT doc_id, regexp_extract(text, '{_SPDX}', 1) AS tag FROM f),
r AS (SELECT fw.doc_id, path, CASE WHEN tag <> '' THEN tag ELSE license END AS license, CASE WHEN tag <> '' THEN 1.0 ELSE cosine END::DOUBLE AS cosine,
             coalesce(whole, false) OR (coalesce(matched, 0) >= {FILE_SHARE} * len(ws) AND (tag <> '' OR license IS NOT NULL)) AS is_file, regexp_replace(path, '/[^/]*$', '') AS dir
      FROM fw LEFT JOIN o USING (doc_id) JOIN s USING (doc_id)),
g AS (SELECT dir, license, cosine, doc_id FROM r WHERE is_file QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, doc_id, license) = 1),
i AS (SELECT r.doc_id, g.license, g.cosine, g.doc_id AS by_ FROM r JOIN g ON r.license IS NULL AND (r.dir = g.dir OR starts_with(r.dir, g.dir || '/'))
      QUALIFY row_number() OVER (PARTITION BY r.doc_id ORDER BY len(g.dir) DESC) = 1)
SELECT r.doc_id, r.path, coalesce(r.license, i.license) AS license, coalesce(r.cosine, i.cosine) AS cosine,
       CASE WHEN r.license IS NOT NULL THEN 'own' WHEN i.license IS NOT NULL THEN 'inherited' END AS how,
       CASE WHEN r.license IS NOT NULL THEN r.doc_id ELSE i.by_ END AS licensed_by
FROM r LEFT JOIN i USING (doc_id)
"""
