"""Licence scans by the Dice coefficient over word bigrams (operator 4), in DataFrame functions only."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

DICE = 0.8

# Notices as their licences or the usual practice word them.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    # Both BSD licences open so; what tells them apart is a clause further on.
    "BSD-2-or-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0-short": "Licensed under CC BY-NC-SA 4.0.",
    "CC0-1.0-short": "Licensed under CC0 1.0.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


def normal_words(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def normalised(text: Column) -> Column:
    """Lower case, each run of other characters than a-z and 0-9 one blank, blanks around."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), F.lit(" "))


def needed(size: int, dice: float) -> int:
    """Bigrams that a text must share with a template of this many to reach the coefficient, for the least text that can: size * dice / (2 - dice)."""
    least = int(-(-size * dice // (2 - dice)))
    return max(1, int(-(-(dice * (size + least)) // 2)))


def index(templates: dict[str, str], dice: float) -> list[tuple[str, int, int, str, int]]:
    """name, words, bigrams, and for the probe bigrams: bigram, its place. A text that reaches the coefficient holds one of any size - needed + 1 bigrams; those in fewest templates serve."""
    sets = {k: list(dict.fromkeys(zip(w, w[1:], strict=False))) for k, t in templates.items() if len(w := normal_words(t)) > 1}
    used: dict[tuple[str, str], int] = {}
    for s in sets.values():
        for b in s:
            used[b] = used.get(b, 0) + 1
    out = []
    for name, s in sets.items():
        words = normal_words(templates[name])
        rare = sorted(s, key=lambda b: (used[b], -len(b[0]) - len(b[1])))[: len(s) - needed(len(s), dice) + 1]
        out += [(name, len(words), len(s), f"{b[0]} {b[1]}", i) for b in rare for i in range(len(words) - 1) if (words[i], words[i + 1]) == b]
    return out


def probes_of(templates: dict[str, str], dice: float) -> list[tuple[str, list[str], int, int, list[str]]]:
    """name, its different bigrams, those a stretch must share, the most that a stretch may have, and the probe bigrams: a stretch of any length that reaches the coefficient holds one."""
    sets = {k: list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))) for k, t in templates.items() if len(w := normal_words(t)) > 1}
    used = Counter(b for s in sets.values() for b in s)
    out = []
    for name, s in sets.items():
        size = len(s)
        share = next((n for n in range(1, size + 1) if 2.0 * n / (n + size) >= dice), None)
        if share is None:
            continue
        most = size
        while 2.0 * size / (most + 1 + size) >= dice:
            most += 1
        out.append((name, sorted(s), share, most, sorted(s, key=lambda b: (used[b], -len(b)))[: size - share + 1]))
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def stretches(dice: float) -> Column:
    """All stretches of ``pairs`` that reach ``dice`` and lose by every word less: (-dice, words, from, to, shared), best, shortest and earliest first.

    Such a stretch starts and ends at a bigram of the template that it holds once. From each such start the different bigrams in order of
    their first places give size and shared bigrams of every end; the start's own bigram met again ends the search. A search looks at
    twice the most bigrams first, and at the rest of the text only where too many of these repeat.
    """

    def from_start(a: Column) -> Column:
        def until_again(n: Column) -> Column:
            def cut(s: Column) -> Column:
                again = F.array_position(F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))), F.element_at(s, 1)).cast("int")
                return let(again, lambda p: F.slice(s, F.lit(1), F.when(p > 0, p).otherwise(F.size(s))))

            return let(F.slice("pairs", a, n), cut)

        def ends(s: Column) -> Column:
            def shared_at(d: Column) -> Column:
                at = F.filter(F.sequence(F.lit(1), F.least(F.size(d), F.col("most"))), lambda k: F.array_contains("t_grams", F.element_at(d, k)))

                def found(held: Column) -> Column:
                    every = F.transform(held, lambda k, j: F.struct((-2.0 * (j + 1) / (k + F.col("t_size"))).alias("back"), k.alias("k"), (j + 1).alias("shared")))
                    reach = F.filter(F.when(F.size(held) >= F.col("share"), every).otherwise(F.slice(every, 1, 0)), lambda x: x["back"] <= -dice)
                    to = lambda x: (a + F.array_position(s, F.element_at(d, x["k"]))).cast("int")
                    return F.transform(reach, lambda x: let(to(x), lambda t: F.struct(x["back"].alias("back"), (t - a + 1).alias("n"), (a - 1).alias("from"), t.alias("to"), x["shared"].alias("shared"))))

                return let(at, found)

            return let(F.array_distinct(s), shared_at)

        first, left = 2 * F.col("most"), F.size("pairs") - a + 1
        near = let(until_again(F.least(first, left)), lambda s: F.when((F.size(s) < F.least(first, left)) | (left <= first) | (F.size(F.array_distinct(s)) >= F.col("most")), s).otherwise(until_again(left)))
        return let(near, ends)

    return F.array_sort(F.flatten(F.transform("starts", from_start)))


def scan_every_length(docs: DataFrame, templates: dict[str, str], dice: float, id_col: str, text_col: str) -> DataFrame:
    """``scan`` over stretches of every length."""
    spark: SparkSession = docs.sparkSession
    probes = probes_of(templates, dice)
    table = spark.createDataFrame([(n, len(g), share, most, g, p) for n, g, share, most, p in probes], "license string, t_size int, share int, most int, t_grams array<string>, probes array<string>")
    rows = common.one_each(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "doc_id", order="text")
    # A generator of one row keeps the optimiser from repeating the expression wherever its result is used.
    rows = rows.select("doc_id", F.explode(F.array(normalised(F.col("text")))).alias("norm"))
    some = F.lit(False)
    for b in sorted({b for p in probes for b in p[4]}):
        some = some | F.contains("norm", F.lit(f" {b} "))
    rows = rows.where(some).select("doc_id", F.explode(F.array(F.split(F.trim("norm"), " "))).alias("words"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.concat_ws(" ", F.element_at("words", i), F.element_at("words", i + 1)))
    rows = rows.where(F.size("words") > 1).select("doc_id", F.explode(F.array(pairs)).alias("pairs"))
    met = rows.join(F.broadcast(table), F.arrays_overlap("pairs", "probes"))
    starts = F.filter(F.sequence(F.lit(1), F.size("pairs")), lambda i: F.array_contains("t_grams", F.element_at("pairs", i)))
    met = met.select("doc_id", "license", "t_size", "share", "most", "t_grams", "pairs", F.explode(F.array(starts)).alias("starts")).where(F.size("starts") >= F.col("share"))
    found = met.select("doc_id", "license", F.explode(F.array(stretches(dice))).alias("found"))
    apart = lambda kept, x: F.forall(kept, lambda y: (x["from"] >= y["to"]) | (y["from"] >= x["to"]))
    best = F.aggregate("found", F.slice("found", 1, 0), lambda kept, x: F.when(apart(kept, x), F.array_append(kept, x)).otherwise(kept))
    return found.select("doc_id", "license", F.explode(best).alias("x")).select("doc_id", "license", F.col("x.from").alias("start_word"), F.col("x.n").alias("n_words"), "x.shared", (-F.col("x.back")).alias("dice"))


def scan(docs: DataFrame, *, templates: dict[str, str] | None = None, dice: float = DICE, every_length: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, start_word, n_words, shared, dice: stretches of a document's normalised words that match a template.

    A document's words are laid along a template wherever both have one of the template's probe bigrams; the stretch under the template
    is compared by 2 * shared / (bigrams of both), different bigrams counted once. Size bounds prune a stretch that the document's
    ends cut too short to reach ``dice``. Of overlapping stretches for one template the best stays (the earliest of equals).

    With ``every_length`` (as the query has it) stretches of every length that can reach ``dice`` are compared, from 0.67 to 1.5 times the
    template's different bigrams at 0.8, so words put in or left out anywhere do not hide a notice; of stretches that share words the best
    stays (the shortest, then the earliest of equals), and what does not overlap it is judged by itself. Without it, only stretches of the
    template's number of words are.

    The template index is a fixed table. Documents without any probe bigram end at a substring test. Null and empty texts
    match nothing; rows without an id are left out; of rows that repeat an id the one with the smallest text (null last) stays. Extra columns are not read.
    """
    if every_length:
        return scan_every_length(docs, templates if templates is not None else TEMPLATES, dice, id_col, text_col)
    spark: SparkSession = docs.sparkSession
    probes = index(templates if templates is not None else TEMPLATES, dice)
    words_of = {name: normal_words(t) for name, t in (templates if templates is not None else TEMPLATES).items()}
    grams = {name: sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}) for name, w in words_of.items()}
    table = spark.createDataFrame([(n, w, s, b, i, grams[n]) for n, w, s, b, i in probes] or [("", 0, 0, "", 0, [])], "license string, t_words int, t_size int, bigram string, place int, t_grams array<string>")
    rows = common.one_each(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "doc_id", order="text")
    # A generator of one row keeps the optimiser from repeating the expression wherever its result is used.
    rows = rows.select("doc_id", F.explode(F.array(normalised(F.col("text")))).alias("norm"))
    some = F.lit(False)
    for b in sorted({p[3] for p in probes}):
        some = some | F.contains("norm", F.lit(f" {b} "))
    rows = rows.where(some).select("doc_id", F.explode(F.array(F.split(F.trim("norm"), " "))).alias("words"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.concat_ws(" ", F.element_at("words", i), F.element_at("words", i + 1)))
    met = rows.where(F.size("words") > 1).select("doc_id", "words", F.posexplode(pairs).alias("at", "bigram")).join(F.broadcast(table), "bigram")
    start = F.col("at") - F.col("place")
    laid = met.select("doc_id", "license", "t_words", "t_size", "t_grams", F.greatest(start, F.lit(0)).alias("from"), F.least(start + F.col("t_words"), F.size("words")).alias("to"), "words").dropDuplicates(["doc_id", "license", "from", "to"])
    most = F.col("to") - F.col("from") - 1
    laid = laid.where(2.0 * most / (most + F.col("t_size")) >= dice)  # as the coefficient itself is worked out, so that equality passes
    own = F.array_distinct(F.transform(F.sequence(F.col("from") + 1, F.col("to") - 1), lambda i: F.concat_ws(" ", F.element_at("words", i), F.element_at("words", i + 1))))
    found = laid.select("doc_id", "license", "t_words", "t_size", "from", "to", F.size(own).alias("size"), F.size(F.array_intersect(own, F.col("t_grams"))).alias("shared"))
    found = found.withColumn("dice", 2.0 * F.col("shared") / (F.col("size") + F.col("t_size"))).where(F.col("dice") >= dice)
    near = Window.partitionBy("doc_id", "license").orderBy(F.expr("`from` * 10000L div t_words")).rangeBetween(-9999, 9999)  # starts less than a template apart
    best = F.max(F.struct(F.col("dice"), (-F.col("from")).alias("back"), F.col("to"))).over(near)
    found = found.withColumn("best", best).where((F.col("best.dice") == F.col("dice")) & (F.col("best.back") == -F.col("from")) & (F.col("best.to") == F.col("to")))
    return found.select("doc_id", "license", F.col("from").alias("start_word"), (F.col("to") - F.col("from")).alias("n_words"), "shared", "dice")
