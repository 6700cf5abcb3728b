"""License scan by the Dice coefficient of word bigrams, with DataFrame functions only.

The whole text is one sequence of words (A-Z in lower case, every run of other than a-z, 0-9 one blank, line ends
included), so notices wrapped over lines and statements inside longer lines are found. A window of consecutive bigrams
is compared, as a set, with each licence template's. With threshold t, a window that matches a template of b bigrams
shares at least t/(2-t)*b with it; windows are at most (2-t)/t*b bigrams long, and only those that begin and end with a
bigram of the template are looked at, for others score no better. Windows that match are taken best first (on ties that
of the longer template, the first name, the first place, the shorter one), each if it shares no word with one taken.
n_license_lines counts the lines with words of windows taken.

A text without any of a template's few anchor words, which together touch more bigrams than may be missing, cannot
match it, so one search for all anchor words drops most texts unread. Everything happens inside the row: no join, no
shuffle. For each template the windows are linear in the text, and each looks at its own words only to see whether
they are taken. The templates are a fixed parameter of the plan.

Defined cases: null, empty and one-word texts match nothing. Among windows taken of equal score the first by name is
reported. Repeated rows and null ids are scanned like others. An empty template list matches nothing. A statement
stretched by repeated words beyond the longest window is not bridged.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The lines by which texts usually state a licence.
TEMPLATES = {
    "agpl-notice": "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "boost": "Distributed under the Boost Software License, Version 1.0.",
    "bsd-3-clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-notice": "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}
THRESHOLD = 0.75
#: Words a long of the set of taken words stands for.
BITS = 60
_WINDOWS = "array<struct<score:double,size:int,rank:int,first:int,last:int>>"
# Words to avoid as anchors.
COMMON = frozenset("a an and any are at by following for in is made of on or source subject that the this to under use version with work you".split())


def bigrams_of(text: str) -> list[str]:
    """The distinct word bigrams of a template, in order."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in low).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def anchors(grams: list[str], threshold: float) -> set[str]:
    """Words of a template, longest first, until a line without them must miss too many of its bigrams."""
    spare = len(grams) - math.ceil(threshold / (2 - threshold) * len(grams) - 1e-9)
    chosen: set[str] = set()
    for w in sorted({w for g in grams for w in g.split()}, key=lambda w: (w in COMMON, -len(w), w)):
        if sum(not chosen.isdisjoint(g.split()) for g in grams) > spare:
            break
        chosen.add(w)
    return chosen


def bounds(b: int, threshold: float) -> tuple[int, int]:
    """(fewest bigrams shared, most bigrams in a window) of matches with a template of b bigrams."""
    return max(1, math.ceil(threshold / (2 - threshold) * b - 1e-9)), math.floor((2 - threshold) / threshold * b + 1e-9)


def _lines_taken(found: str, lines: str) -> Column:
    """How many lines have words of windows taken: windows go in their order, each if all of its words are free.

    The words taken are a bit set, BITS a long. A window looks at its own few longs, wherever it lies; what grows with the
    text is a copy of the set for each window taken. lines: of each word.
    """
    low, high = f"greatest(w.first - k * {BITS}, 0)", f"least(w.last + 1 - k * {BITS}, {BITS - 1})"
    mask = f"shiftleft(shiftleft(1L, {high} - {low} + 1) - 1L, {low})"
    first, last = f"cast(w.first div {BITS} AS int)", f"cast((w.last + 1) div {BITS} AS int)"
    blocks = f"sequence({first}, {last})"
    free = f"forall({blocks}, k -> (get(bits, k) & {mask}) = 0)"
    marked = f"concat(slice(bits, 1, {first}), transform({blocks}, k -> get(bits, k) | {mask}), slice(bits, {last} + 2, greatest(size(bits) - {last} - 1, 0)))"
    taken = f"filter({lines}, (x, i) -> (get(bits, cast((i + 1) div {BITS} AS int)) & shiftleft(1L, cast((i + 1) % {BITS} AS int))) <> 0)"
    return F.expr(f"aggregate({found}, array_repeat(0L, cast((size({lines}) + 1) div {BITS} AS int) + 1), (bits, w) -> CASE WHEN {free} THEN {marked} ELSE bits END, bits -> size(array_distinct({taken})))")


def licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, license (the best one, or null), dice (0 without), n_license_lines."""
    sets = {k: b for k, v in sorted((TEMPLATES if templates is None else templates).items()) if (b := bigrams_of(v))}
    if not sets:
        return docs.select("doc_id", F.lit(None).cast("string").alias("license"), F.lit(0.0).alias("dice"), F.lit(0).cast("long").alias("n_license_lines"))
    any_of = sorted(set().union(*(anchors(b, threshold) for b in sets.values())))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words_of = lambda x: F.filter(F.split(F.regexp_replace(x, "[^a-z0-9]+", " "), " ", -1), lambda w: w != "")
    words = F.flatten(F.transform(F.split(low, "\n", -1), lambda x, i: F.transform(words_of(x), lambda w: F.struct(w.alias("w"), i.alias("line")))))
    out = docs.select("doc_id", F.when(text.rlike("(?i)(?<![a-z0-9])(?:" + "|".join(any_of) + ")(?![a-z0-9])"), words).alias("words"))
    n = F.size("words")
    pairs = F.zip_with(F.slice("words", F.lit(1), n - 1), F.slice("words", F.lit(2), n - 1), lambda a, b: F.concat(a["w"], F.lit(" "), b["w"]))
    out = out.select("doc_id", F.when(n > 1, F.transform("words", lambda x: x["line"])).alias("lines"), F.when(n > 1, pairs).alias("grams"))
    # Places count from 1. Of all bigrams, those of any template first, then each template's own.
    hits = F.filter(F.transform("grams", lambda g, p: F.struct((p + 1).alias("p"), g.alias("g"))), lambda h: h["g"].isin(sorted(set().union(*sets.values()))))
    out = out.select("doc_id", "lines", "grams", hits.alias("hits"))
    places = lambda b: F.transform(F.filter("hits", lambda h: h["g"].isin(b)), lambda h: h["p"])
    out = out.select("doc_id", "lines", "grams", *(places(b).alias(f"own{i}") for i, b in enumerate(sets.values())))

    def windows(i: int, b: list[str]) -> Column:
        least, most = bounds(len(b), threshold)
        own = F.col(f"own{i}")

        def scored(first: Column, last: Column) -> Column:
            g = F.slice("grams", first, last - first + 1)
            dice = 2.0 * F.size(F.array_intersect(g, F.array(*map(F.lit, b)))) / (F.size(F.array_distinct(g)) + len(b))
            return F.struct((-dice).alias("score"), F.lit(-len(b)).alias("size"), F.lit(i).alias("rank"), first.alias("first"), last.alias("last"))

        begun = F.transform(own, lambda first, j: F.transform(F.filter(F.slice(own, j + least, F.lit(most)), lambda last: last - first < most), lambda last: scored(first, last)))
        return F.when(F.size(own) >= least, F.filter(F.flatten(begun), lambda x: x["score"] <= -threshold)).otherwise(F.array().cast(_WINDOWS))

    found = F.sort_array(F.concat(*(windows(i, b) for i, b in enumerate(sets.values()))))
    out = out.select("doc_id", "lines", found.alias("found"))
    out = out.select("doc_id", F.get("found", F.lit(0)).alias("top"), F.when(F.size("found") > 0, _lines_taken("found", "lines")).alias("n"))
    name = reduce(lambda rest, x: F.when(F.col("top.rank") == x[0], x[1]).otherwise(rest), enumerate(sets), F.lit(None).cast("string"))
    return out.select("doc_id", name.alias("license"), F.round(F.coalesce(-F.col("top.score"), F.lit(0.0)), 9).alias("dice"), F.greatest(F.lit(0), F.coalesce("n", F.lit(0))).cast("long").alias("n_license_lines"))


def _sql() -> str:
    t = THRESHOLD
    sets = {k: bigrams_of(v) for k, v in sorted(TEMPLATES.items())}
    rows = ", ".join(f"('{k}', '{g}')" for k, b in sets.items() for g in b)
    sizes = ", ".join(f"('{k}', {len(b)}, {bounds(len(b), t)[0]}, {bounds(len(b), t)[1]})" for k, b in sets.items())
    return f"""
WITH templates(license, g) AS (VALUES {rows}),
sizes(license, b, fewest, longest) AS (VALUES {sizes}),
lines AS (SELECT rid, line_no, list_filter(string_split(line, ' '), lambda x: x <> '') AS w FROM (
  SELECT rid, unnest(l) AS line, generate_subscripts(l, 1) AS line_no FROM (
    SELECT rowid AS rid, string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\\n]+', ' ', 'g'), chr(10)) AS l
    FROM (SELECT row_number() OVER () AS rowid, text FROM (SELECT doc_id, text FROM documents ORDER BY doc_id))))),
words AS (SELECT rid, line_no, w, row_number() OVER (PARTITION BY rid ORDER BY line_no, i) AS p FROM (SELECT rid, line_no, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM lines)),
grams AS (SELECT x.rid, x.p, x.w || ' ' || y.w AS g FROM words x JOIN words y ON x.rid = y.rid AND y.p = x.p + 1),
own AS (SELECT rid, license, p, row_number() OVER (PARTITION BY rid, license ORDER BY p) AS r FROM grams JOIN templates USING (g)),
near AS (SELECT x.rid, license, b, x.p AS f, y.p AS l FROM own x JOIN own y USING (rid, license) JOIN sizes USING (license) WHERE y.r >= x.r + fewest - 1 AND y.p - x.p < longest),
scored AS (SELECT near.rid, near.license, b, f, l, 2.0::DOUBLE * count(DISTINCT grams.g) FILTER (templates.g IS NOT NULL) / (count(DISTINCT grams.g) + b) AS dice
  FROM near JOIN grams ON grams.rid = near.rid AND grams.p BETWEEN f AND l LEFT JOIN templates ON templates.license = near.license AND templates.g = grams.g GROUP BY near.rid, near.license, b, f, l),
best AS (SELECT rid, list([{{'license': license, 'dice': dice, 'f': f, 'l': l}}] ORDER BY dice DESC, b DESC, license, f, l) AS found FROM scored WHERE dice >= {t} GROUP BY rid),
taken AS (SELECT rid, unnest(list_reduce(found, lambda got, x: CASE WHEN len(list_filter(got, lambda y: y.f <= x[1].l + 1 AND x[1].f <= y.l + 1)) > 0 THEN got ELSE got || x END)) AS m FROM best),
top AS (SELECT rid, (list(m.license ORDER BY m.dice DESC, m.license))[1] AS license, max(m.dice) AS dice, count(DISTINCT line_no) AS n_license_lines FROM taken JOIN words USING (rid) WHERE p BETWEEN m.f AND m.l + 1 GROUP BY rid)
SELECT doc_id, license, round(coalesce(dice, 0), 9) AS dice, coalesce(n_license_lines, 0)::BIGINT AS n_license_lines
FROM (SELECT row_number() OVER () AS rid, doc_id FROM (SELECT doc_id FROM documents ORDER BY doc_id)) LEFT JOIN top USING (rid)"""


SQL = _sql()
