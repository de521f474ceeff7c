"""License scans: TF-IDF cosine of notices and licence files to templates, and inheritance along directories.

DataFrame functions only.
"""

from __future__ import annotations

import functools
import json
import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

#: Notices of licences as they stand in headers and licence files (fixed values).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3 or later."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved. Unauthorized copying of this file is strictly prohibited. Proprietary and confidential."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Notices and versions that are looked for in windows of words only, as the templates above are held in SQL too (fixed values).
NOTICES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-1.1", "Licensed under the Apache Software License, Version 1.1."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-2.0", "This work is licensed under a Creative Commons Attribution 2.0 License."),
    ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
    ("CC-BY-NC-3.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 3.0 Unported License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-SA-3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("EPL-1.0", "Made available under the terms of the Eclipse Public License v1.0."),
    ("EPL-2.0", "Made available under the terms of the Eclipse Public License 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Licensed under the ISC License."),
    ("LGPL-2.0", "Licensed under the GNU Library General Public License, version 2."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License)."),
)
#: Whole licence texts, one file for each.
TEXTS = Path(__file__).parent / "licence_texts"
#: A line that holds none of these is no notice (fixed values).
CUES = ("licen", "copyright", "spdx", "permission", "redistribut", "rights reserved", "public domain")
#: File names that licences are kept under (fixed values).
LICENCE_FILES = ("license", "licence", "copying", "unlicense", "notice")
#: Least cosine of a notice, and of a whole text that is a licence file without such a name.
HEADER, WHOLE = 0.6, 0.6
#: The words of a cue that stand in a notice, and the least cosine of a window of words, which has no rest of a line to lower it.
STEMS, WINDOW = ("licen", "copyright", "spdx", "permission", "redistribut", "reserved", "domain"), 0.75
#: An SPDX tag with its expression.
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*((?:[()\w.+-]+)(?:[ \t]+(?:AND|OR|WITH)[ \t]+[()\w.+-]+)*)"


def _words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def template_weights(templates=TEMPLATES) -> tuple[list[tuple[int, str, float]], dict[str, float], float]:
    """Unit TF-IDF vectors of the templates as (template, word, weight), each word's idf, and the idf of others."""
    sets = [set(_words(t)) for _, t in templates]
    n = len(sets)
    idf = {w: math.log((1 + n) / (1 + sum(w in s for s in sets))) + 1 for w in set().union(*sets)}
    rows = []
    for k, (_, text) in enumerate(templates):
        words = _words(text)
        weight = {w: words.count(w) * idf[w] for w in words}
        norm = math.sqrt(sum(x * x for x in weight.values()))
        rows += [(k, w, x / norm) for w, x in sorted(weight.items())]
    return rows, idf, math.log(1 + n) + 1


def _held(low: Column) -> Column:
    out = F.lit(False)
    for cue in CUES:
        out = out | low.contains(cue)
    return out


def _cued(text: Column) -> Column:
    """Whether a line holds a cue; in an array of one, so that its lower case is made once."""
    return F.exists(F.array(F.lower(text)), _held)


def _cued_text(text: Column) -> Column:
    """Whether a text holds a cue, the two of two words across line breaks and comment signs too; false for null."""
    across = lambda low: (low.contains("reserved") | low.contains("domain")) & low.rlike("rights[^a-z0-9]+reserved|public[^a-z0-9]+domain")
    return F.coalesce(F.exists(F.array(F.lower(text)), lambda low: _held(low) | across(low)), F.lit(False))


def _listed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed table, from one literal."""
    names = [x.split()[0] for x in schema.split(", ")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    return F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(text), "array<struct<" + schema.replace(", ", ",").replace(" ", ":") + ">>"))))


#: A table of at most so many short rows, as counted, is sent to all tasks; a larger one is joined by its key.
SENT = 200_000


def _looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows with what table (materialized, one row for each key) has of their key, if anything."""
    return rows.join(F.broadcast(table) if table.count() <= SENT else table, key, "left")


def _matches(segments: DataFrame, keys: list[str], text: str, least: float, templates=TEMPLATES) -> DataFrame:
    """keys, license, score of the best template for each segment, if its cosine is `least` or more."""
    spark = segments.sparkSession
    rows, idf, other = template_weights(templates)
    weights = _listed(spark, rows, "template int, word string, weight double")  # the templates' words
    idfs = _listed(spark, sorted(idf.items()), "word string, idf double")
    names = _listed(spark, [(k, x[0]) for k, x in enumerate(templates)], "template int, license string")
    words = segments.select(*keys, F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))).alias("word"))
    counts = words.groupBy(*keys, "word").count().join(idfs, "word", "left")
    counts = counts.withColumn("w", F.col("count") * F.coalesce("idf", F.lit(other)))
    norms = counts.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = counts.where("idf is not null").join(weights, "word").groupBy(*keys, "template").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, keys).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= least)
    best = scored.join(names, "template").groupBy(*keys).agg(F.max_by(F.struct("license", "score"), F.struct(F.col("score"), -F.col("template"))).alias("best"))
    return best.select(*keys, "best.license", "best.score")


@functools.cache
def _places() -> list[tuple[int, int, int]]:
    """(stem, words before it, words in all) of the notices' cue words: the windows in which a notice may stand around one."""
    out = set()
    for _, text in (*TEMPLATES, *NOTICES):
        words = _words(text)
        out |= {(next(k for k, x in enumerate(STEMS) if x in w), i, len(words)) for i, w in enumerate(words) if any(x in w for x in STEMS)}
    return sorted(out)


def _window_matches(cued: DataFrame) -> DataFrame:
    """(id, license, score) of each text's windows that are close to a notice; windows run over line breaks."""
    stem = lambda w: F.coalesce(*[F.when(w.contains(x), F.lit(k)) for k, x in enumerate(STEMS)])
    most = max(n for _, _, n in _places())
    spots = F.filter(F.transform("words", lambda w, i: F.struct(stem(w).alias("stem"), i.alias("i"))), lambda x: x["stem"].isNotNull())
    # each spot with the words around it; those before the text are left out
    start = lambda x: F.greatest(x["i"] - F.lit(most) + 1, F.lit(0))
    around = F.transform(spots, lambda x: F.struct(x["stem"].alias("stem"), (x["i"] - start(x)).alias("at"), F.slice("words", start(x) + 1, F.lit(2 * most)).alias("near")))
    places = _listed(cued.sparkSession, _places(), "stem int, before int, length int")
    rows = cued.select("id", F.explode(around).alias("x")).select("id", "x.*").join(places, "stem").where("at >= before")
    windows = rows.select("id", F.array_join(F.slice("near", F.greatest(F.col("at") - F.col("before") + 1, F.lit(1)), F.col("length")), " ").alias("window"))
    windows = windows.select(F.xxhash64("window").alias("window_id"), "id", "window").dropDuplicates(["window_id", "id"])
    found = _matches(windows.select("window_id", "window").dropDuplicates(["window_id"]), ["window_id"], "window", WINDOW, (*TEMPLATES, *NOTICES))
    return windows.select("id", "window_id").join(found, "window_id").select("id", "license", "score")


def _spdx_matches(cued: DataFrame) -> DataFrame:
    """(id, license, score) of the identifiers in SPDX tags, whether they are known or not; 'only' and 'or later' are left off."""
    expressions = F.regexp_extract_all("text", F.lit(SPDX), F.lit(1))
    bare = cued.select("id", F.explode(expressions).alias("e")).select("id", F.regexp_replace("e", r"(?i)[ \t]WITH[ \t]+[\w.+-]+", "").alias("e"))
    names = bare.select("id", F.explode(F.split(F.trim(F.regexp_replace("e", r"(?i)[ \t()]+((AND|OR)[ \t()]+)?", " ")), " ")).alias("name"))
    return names.where("name <> ''").select("id", F.regexp_replace("name", r"(?i)(-only|-or-later|\+)$", "").alias("license"), F.lit(1.0).alias("score"))


@functools.cache
def _full_texts() -> list[tuple[str, str, float]]:
    """(license, three words, weight) of the whole licence texts, as unit vectors of counts."""
    rows = []
    for file in sorted(TEXTS.glob("*.txt")):
        words = _words(file.read_text(encoding="utf-8"))
        counts = Counter(" ".join(words[i : i + 3]) for i in range(len(words) - 2))
        norm = math.sqrt(sum(n * n for n in counts.values()))
        rows += [(file.stem, g, n / norm) for g, n in sorted(counts.items())]
    return rows


def _full_matches(cued: DataFrame) -> DataFrame:
    """(id, all): texts that are a whole licence text, by the cosine of counts of three words in a row.

    Single words would not do: any long text shares the frequent ones.
    """
    grams = _listed(cued.sparkSession, _full_texts(), "license string, gram string, weight double")  # the licences' words
    three = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - 2, F.lit(1))), lambda i: F.array_join(F.slice("words", i, 3), " "))
    counts = cued.where("size(words) > 2").select("id", F.explode(three).alias("gram")).groupBy("id", "gram").count()
    norms = counts.groupBy("id").agg(F.sqrt(F.sum(F.col("count") * F.col("count"))).alias("norm"))
    dots = counts.join(grams, "gram").groupBy("id", "license").agg(F.sum(F.col("count") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, "id").select("id", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= WHOLE)
    return scored.groupBy("id").agg(F.max_by(F.struct("license", "score"), F.struct("score", "license")).alias("full"))


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan_licenses(files: DataFrame, path: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The licence of every file: its own notice's, or that of the nearest directory above that has a licence file.

    Returns (doc_id, path, license, how, score), one row for each row of files: how is 'header' (a line of the
    text, or a window of words around a cue, anywhere in it and over line breaks, is close to a notice, or an SPDX tag names a
    licence), 'file' (the file is a licence file), 'inherited' or 'none'; score is the TF-IDF cosine, 1 for a tag, and the
    cosine of counts of three words for a whole licence text. A licence file is one that is named like one and holds a
    notice, or whose whole text is close to a template or to a licence's text.
    Where a text's own notice names another licence than its whole does, the higher cosine holds.
    Directories with several licences take the one with the higher cosine, ties to the name that sorts last. A null
    text or path holds nothing and inherits nothing; repeated rows each get a row; an empty table gives none; other columns
    are not read.

    Words that no template has count in a text's length, so that long lines that merely mention a licence stay
    below. Templates are broadcast, and licences by text and by folder where a count finds few enough; lines without a
    cue never leave the scan.
    """
    rows = files.select(F.col(doc_id).alias("doc_id"), path.cast("string").alias("path"), F.col(text).alias("text"))
    # two reads of the texts: short rows of all files, with a key for those with a cue, and the texts with a cue, each once
    short = materialize(rows.select("doc_id", "path", F.when(_cued_text(F.col("text")), F.md5("text")).alias("key")), "files")
    cued = rows.where(_cued_text(F.col("text"))).select(F.md5("text").alias("key"), "text").dropDuplicates(["key"]).withColumn("id", F.monotonically_increasing_id())
    cued = materialize(cued.withColumn("words", F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))), "cued")
    lines = cued.select("id", F.posexplode(F.filter(F.split("text", "[\n\r]+"), lambda x: _cued(x))).alias("line", "notice"))
    lines = lines.withColumn("notice", F.trim("notice")).select(F.xxhash64("notice").alias("notice_id"), "id", "notice")
    notices = _matches(lines.select("notice_id", "notice").dropDuplicates(["notice_id"]), ["notice_id"], "notice", HEADER)
    best = lambda: F.max_by(F.struct("license", "score"), F.struct(F.col("score"), F.col("license")))
    own = lines.select("id", "notice_id").join(notices, "notice_id").select("id", "license", "score")
    own = own.unionByName(_window_matches(cued)).unionByName(_spdx_matches(cued)).groupBy("id").agg(best().alias("own"))
    whole = _matches(cued, ["id"], "text", WHOLE).select("id", F.struct("license", "score").alias("all"))
    whole = whole.join(_full_matches(cued), "id", "full").select("id", F.coalesce("all", "full").alias("all"))
    # what follows reads it several times
    kinds = materialize(own.join(whole, "id", "full").join(cued.select("id", "key"), "id").drop("id"), "kinds")
    # most texts have no cue: they meet no notice, and their null key no task
    kind = F.lit(None).cast("struct<license:string,score:double>")
    found = _looked_up(short.where("key is not null"), kinds, "key").select("doc_id", "path", "own", "all")
    found = found.unionByName(short.where("key is null").select("doc_id", "path", kind.alias("own"), kind.alias("all")))
    base = F.lower(F.regexp_extract("path", "([^/]*)$", 1))
    is_file = F.col("all").isNotNull() | (F.col("own").isNotNull() & F.regexp_extract(base, "^([a-z]+)", 1).isin(*LICENCE_FILES))
    found = materialize(found.select(
        "doc_id", "path", is_file.alias("is_file"), F.when(F.col("own.license") != F.col("all.license"), F.when(F.col("own.score") > F.col("all.score"), F.col("own")).otherwise(F.col("all"))).otherwise(F.coalesce("all", "own")).alias("mine"), folder(F.col("path")).alias("folder"),
    ), "found")
    folders = found.where("is_file and path is not null").groupBy("folder").agg(F.max_by("mine", F.struct(F.col("mine.score"), F.col("mine.license"))).alias("theirs")).select(F.col("folder").alias("above"), "theirs")
    # ancestors are joined once for each folder, not for each file
    bare = found.where("mine is null and path is not null").select("folder").distinct()
    steps = F.split("folder", "/")
    above = bare.select("folder", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))).alias("above"))
    heirs = above.join(folders, "above").groupBy("folder").agg(F.max_by("theirs", F.length("above")).alias("theirs"))
    out = _looked_up(found, materialize(heirs, "heirs"), "folder")
    mine, theirs = F.col("mine"), F.when(F.col("mine").isNull(), F.col("theirs"))
    return out.select(
        "doc_id", "path", F.coalesce(mine["license"], theirs["license"]).alias("license"),
        F.when(F.col("is_file"), "file").when(mine.isNotNull(), "header").when(theirs.isNotNull(), "inherited").otherwise("none").alias("how"),
        F.coalesce(mine["score"], theirs["score"]).alias("score"),
    )
