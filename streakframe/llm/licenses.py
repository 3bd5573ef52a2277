"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

A text's words are cut into windows that overlap by the longest template, so every notice lies whole in some window. Templates
are partitioned by size, and a window has MinHash bands for each partition, so many that a notice meets its template with all
but a stated chance: the larger a partition's templates, the fewer bands (`minhash.py`). Templates of a few shingles (eight at
most, some of just one) are an exact class: bands would keep nearly all of a window's shingles, so all are looked up. A
template that meets a window is verified by the share of its word shingles that the window holds. Everything is a DataFrame
expression; the templates are constants.

Defined cases: null, empty and blank texts give no rows; a text shorter than a shingle is one shingle; documents with equal
ids are one document; a notice in several windows counts in the best; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streakframe.llm.common import once, shingle_hashes, words
from streakframe.llm.minhash import finest, meeting, nested_signatures, size_classes

SIZE = 5
SHARE = 0.8
#: Public license notices, by SPDX name. Fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies."
    ),
    "LGPL": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "MIT": "Released under the MIT License",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}


def _plain(text):
    """Marks at the ends of words don't count, case neither."""
    return F.regexp_replace(text, r"[.,;:()\"]+(?=[\x20\x09-\x0D]|$)|(?<=[\x20\x09-\x0D]|^)[(\"]+", "")


def template_shingles(spark: SparkSession, templates: dict[str, str], size: int) -> dict[str, list[int]]:
    rows = spark.createDataFrame(list(templates.items()), "license string, text string")
    return {r.license: sorted(set(r.s)) for r in rows.select("license", shingle_hashes(words(_plain(F.col("text"))), size).alias("s")).collect()}


def scan(spark: SparkSession, docs: DataFrame, templates: dict[str, str] | None = None, size: int = SIZE, share: float = SHARE, chance: float = 1e-6) -> DataFrame:
    """(doc_id, license, n_shingles, matched, containment, window): each template with at least `share` of its shingles in one window.

    window: the first word of the best window, the earliest of equals. chance: a notice of the least wanted share is missed with
    this chance at most; a whole one far less often, and one of an exact class never.
    """
    known = template_shingles(spark, templates or TEMPLATES, size)
    stride = max(len(s) for s in known.values())
    window = 2 * stride
    classes = size_classes([len(s) for s in known.values()], share, chance)
    by_class = {c: {h for s in known.values() if c.low < len(s) <= c.high for h in s} for c in classes}

    hashed = once(docs.where(F.col("text").isNotNull()), ["doc_id"], s=shingle_hashes(words(_plain(F.col("text"))), size)).where(F.size("s") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("s") - stride - 1, F.lit(0)), F.lit(stride))
    windows = hashed.select("doc_id", F.explode(F.transform(starts, lambda i: F.struct(i.alias("at"), F.sort_array(F.slice("s", i + 1, F.lit(window))).alias("s")))).alias("x"))
    windows = windows.select("doc_id", F.col("x.at").alias("window"), F.col("x.s").alias("s"))
    key, banded = ["doc_id", "window", "s"], [c for c in classes if c.bins is not None]
    # most windows meet nothing in the bands of the smallest templates, and so nothing in any others
    first = {c: by_class[c] if c.bins is None else {h for b in banded for h in by_class[b]} for c in finest(classes)}
    least = banded[-1].bins if banded else None
    some = once(windows, key, sig=nested_signatures(F.col("s"), F.size("s"), finest(classes), least))
    some = once(some, key, any=meeting(finest(classes), first)).where(F.size("any") > 0)
    met = once(once(some, key, sig=nested_signatures(F.col("s"), F.size("s"), classes)), key, met=meeting(classes, by_class)).where(F.size("met") > 0)
    meets = {name: F.expr(f"exists(met, h -> h in ({','.join(f'{h}L' for h in s)}))") for name, s in known.items()}
    tests = [
        F.when(
            meets[name],
            F.struct(F.lit(name).alias("license"), F.lit(len(s)).alias("n_shingles"), F.size(F.array_intersect("s", F.array(*map(F.lit, s)))).alias("matched")),
        )
        for name, s in known.items()
    ]
    found = met.select("doc_id", "window", F.explode(F.array_compact(F.array(*tests))).alias("x")).select("doc_id", "window", "x.*")
    good = found.withColumn("containment", F.col("matched") / F.col("n_shingles")).where(F.col("containment") >= share)
    best = F.max(F.struct("matched", (-F.col("window")).alias("before")))
    rows = good.groupBy("doc_id", "license", "n_shingles").agg(best.alias("b"))
    matched = F.col("b.matched")
    return rows.select("doc_id", "license", "n_shingles", matched.alias("matched"), (matched / F.col("n_shingles")).alias("containment"), (-F.col("b.before")).alias("window"))
