"""License scans by diagonal voting.

Every run of K words of every document is hashed and joined to the places of the templates' runs. A match votes for
its diagonal (place in the document less place in the template); neighbouring diagonals merge; what has the votes
that a text within the edit budget must have is verified by a banded alignment of the template with the document's
words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, ship, small, stored
from .decontaminate import align, best
from .textbytes import Words, grams, pieces

K = 3
#: Edits (words put in, left out or changed) allowed for each word of a template.
RATE = 0.2

#: Short notices and the main paragraphs of common licenses.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0",
    "MIT notice": "Released under the MIT License",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "Zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",
}

SCHEMA = "doc_id bigint, license string, start int, end int, edits int"


def template_words(templates: dict[str, str]) -> dict[str, np.ndarray]:
    """Word hashes of each template that has K words."""
    out = {}
    for name, text in templates.items():
        for _, _, data, offsets in pieces(pa.array([text])):
            h = Words(data, offsets, bigrams=False).hash
            if len(h) >= K:
                out[name] = h
    return out


def budget(m: int, rate: float) -> tuple[int, int]:
    """Edits allowed for a template of m words, and the runs that it then shares at least."""
    e = max(0, min(int(rate * m), (m + 1) // K - 1))
    return e, max(1, m + 1 - K * (e + 1))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, _, data, offsets in pieces(b.column(2)):
            w = Words(data, offsets, bigrams=False)
            h, row, place = grams(w.hash, w.of, K)
            at = pa.array(row + lo)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(place.astype(np.int32)), pa.array(h.view(np.int64))], ["doc_id", "digest", "place", "run"])


def _verify(words: list[np.ndarray], names: list[str], rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted = b.column(2).to_pylist()
            rows, found = [], []
            for lo, hi, data, offsets in pieces(b.column(1)):
                w = Words(data, offsets, bigrams=False)
                for r in range(hi - lo):
                    text = w.hash[w.of[r] : w.of[r + 1]]
                    spans = []
                    for c in wanted[lo + r]:
                        t = words[c["template"]]
                        e, _ = budget(len(t), rate)
                        first = np.arange(c["low"] - e, c["high"] + 1, e + 1)
                        ends = np.zeros(len(first), np.int64), np.full(len(first), len(text))
                        edits, start, end = align(t, text, first, 2 * (e + 1), *ends)
                        spans += [(0, c["template"], int(start[i]), int(end[i]), int(edits[i])) for i in np.flatnonzero(edits <= e)]
                    for _, t, start, end, edits in best(spans):
                        rows.append(lo + r)
                        found.append((names[t], start, end, edits))
            cols = list(zip(*found)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.string()), *(pa.array(c, pa.int32()) for c in cols[1:])], ["doc_id", "license", "start", "end", "edits"])

    return run


def license_spans(docs: DataFrame, templates: dict[str, str] | None = None, rate: float = RATE) -> DataFrame:
    """doc_id, license, start, end (in words) and edits for each place in docs that holds a template's text.

    Words are compared in lower case without punctuation. Of spans of one template that overlap, that with the fewest
    edits counts, the first of equals; spans of different templates may overlap. Null and empty texts and templates of
    fewer than K words have none. A null doc_id gives rows with a null doc_id; a repeated row gives its spans again.
    """
    spark = docs.sparkSession
    ship(spark)
    known = template_words(TEMPLATES if templates is None else templates)
    if not known:
        return spark.createDataFrame([], SCHEMA)
    names, words = list(known), list(known.values())
    places = []
    for t, h in enumerate(words):
        run, _, place = grams(h, np.array([0, len(h)]), K)
        places += zip(run.view(np.int64).tolist(), [t] * len(run), place.tolist())
    where = small(spark.createDataFrame(places, "run bigint, template int, at int"))
    limits = [budget(len(h), rate) for h in words]
    gap = F.element_at(F.array(*[F.lit(max(1, e)) for e, _ in limits]), F.col("template") + 1)
    least = F.element_at(F.array(*[F.lit(n) for _, n in limits]), F.col("template") + 1)

    texts = docs.where("text <> ''").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("digest"), F.col("text").cast("string").alias("text"))
    doc = ["doc_id", "digest", "template"]
    votes = (
        texts.mapInArrow(_runs, "doc_id bigint, digest bigint, place int, run bigint")
        .join(where, "run")
        .groupBy(*doc, (F.col("place") - F.col("at")).alias("diagonal"))
        .agg(F.count_distinct("at").alias("votes"))
    )
    order = Window.partitionBy(*doc).orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > gap, F.lit(True))
    merged = votes.withColumn("new", new.cast("int")).withColumn("group", F.sum("new").over(order)).groupBy(*doc, "group").agg(F.sum("votes").alias("votes"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high"))
    candidates = stored(merged.where(F.col("votes") >= least).groupBy("doc_id", "digest").agg(F.collect_list(F.struct("template", "low", "high")).alias("spans")), "spans")
    side = small(candidates.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), "spans"))
    both = texts.join(side, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest"))).select("doc_id", "text", "spans")
    return both.mapInArrow(_verify(words, names, rate), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_spans(read(spark, sf_dir, "documents"))
