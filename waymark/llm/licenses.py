"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Every line of a file is a header candidate, so is every run of lines up to 1 / threshold²
times the words of the longest notice, and a file named like a licence file is one as a whole;
each is compared with notice templates by the cosine of sparse TF-IDF vectors.  A licence file
is first compared with the full texts of licences; the Creative Commons ones but CC0 have none
here.  A licence that contains the notice of another outranks it.  Term
weights come from the document frequencies of the templates' terms over all files; a term
that no template has gets the weight of a term in no file.  A file takes the licence of its
best line at or above ``threshold``; a licence file gives its licence to its directory.  A
file with no licence of its own inherits from the nearest ancestor directory that has one, by
joins on directory paths: directories are made distinct first, so a directory with a third of
all files is one row of that join.

Nulls and empty texts have no licence of their own and may inherit; null paths inherit
nothing.  Ties go to the first template in order of names, and among licence files of one
directory to the highest score, then the first name.  Repeated rows give repeated results; very long texts are read whole.
An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.arrow import derive, slices, small_batches
from waymark.llm.scratch import materialize

#: Notices by licence: fixed texts that licences ask to be put into files.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "ISC": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    "MPL-2.0": ("Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
#: Licences whose texts contain the notice of another.
CONTAINS = {"BSD-3-Clause": "BSD-2-Clause"}
#: File names that mark a licence file.
LICENSE_FILES = r"(?i)^(?:un)?licen[cs]e(?:[.-].*)?$|^copying(?:[.-].*)?$|^notice(?:\..*)?$"

_TERM = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


class Matcher:
    """Template vectors under given document frequencies."""

    def __init__(self, templates: dict[str, tuple[str, ...]], frequencies: dict[str, int], files: int):
        weigh = lambda df: math.log((files + 1) / (df + 1)) + 1
        self.other = weigh(0)
        self.notices = [(name, Counter(terms(t))) for name in sorted(templates) for t in templates[name]]
        self.weight = {t: weigh(frequencies.get(t, 0)) for _, c in self.notices for t in c}
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for k, (_, counts) in enumerate(self.notices):
            norm = math.sqrt(sum((n * self.weight[t]) ** 2 for t, n in counts.items()))
            for t, n in counts.items():
                self.postings.setdefault(t, []).append((k, n * self.weight[t] / norm))

    def best(self, words: list[str], least: float) -> tuple[str, float] | None:
        """(licence, cosine) of the nearest notice, if at least ``least``."""
        known = [w for w in words if w in self.weight]
        if not known:
            return None
        dots: dict[int, float] = {}
        square = 0.0
        for t, n in Counter(known).items():
            v = n * self.weight[t]
            square += v * v
            for k, u in self.postings[t]:
                dots[k] = dots.get(k, 0.0) + u * v
        k = min(dots, key=lambda k: (-round(dots[k], 12), k))
        if dots[k] < least * math.sqrt(square):
            return None
        if len(known) < len(words):
            square += self.other**2 * sum(n * n for n in Counter(w for w in words if w not in self.weight).values())
        score = dots[k] / math.sqrt(square)
        return (self.notices[k][0], score) if score >= least else None


    def best_run(self, lines: list[list[str]], least: float) -> list[tuple[str, float]]:
        """Matches of runs of two lines or more, given the words of each line."""
        lines = [words for words in lines if words]
        most = max((sum(c.values()) for _, c in self.notices), default=0) / least**2
        known = [[w for w in words if w in self.weight] for words in lines]
        out = []
        for first in range(len(lines) - 1):
            if not known[first]:
                continue
            words, counts, square, other = 0, Counter(), 0.0, 0.0
            for last in range(first, len(lines)):
                words += len(lines[last])
                if words > most:
                    break
                for w in known[last]:
                    square += (2 * counts[w] + 1) * self.weight[w] ** 2
                    counts[w] += 1
                other += (len(lines[last]) - len(known[last])) * self.other**2
                # What no notice has may not outweigh the rest; repeated, it only weighs more.
                if last > first and square >= least**2 * (square + other) and (m := self.best([w for x in lines[first : last + 1] for w in x], least)):
                    out.append(m)
        return out


def full_texts() -> dict[str, tuple[str, ...]]:
    return {p.stem: (p.read_text(encoding="utf-8"),) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def scan(files: DataFrame, *, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates: dict[str, tuple[str, ...]] | None = None, texts: dict[str, tuple[str, ...]] | None = None, threshold: float = 0.8, license_files: str = LICENSE_FILES) -> DataFrame:
    """One row per file: doc_id, path, license, how (header, file, inherited or null), score, license_dir (of what was inherited)."""
    # Templates of one's own come without the full texts.
    texts = (full_texts() if templates is None else {}) if texts is None else texts
    templates = TEMPLATES if templates is None else templates
    picked = files.select(F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("text"))
    vocabulary = frozenset(t for notices in (*templates.values(), *texts.values()) for n in notices for t in terms(n))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for b in slices(batches):
            seen[""] += b.num_rows
            for t in b.column("text").to_pylist():
                if t:
                    seen.update(vocabulary.intersection(terms(t)))
        yield pa.record_batch({"term": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    small_batches(files.sparkSession)
    # At most one row for each term of the templates reaches the driver.
    counted = {r["term"]: r["n"] for r in picked.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    matcher = Matcher(templates, counted, counted.get("", 0))
    whole = Matcher(texts, counted, counted.get("", 0))
    named = re.compile(license_files)

    def match(files: list[dict]) -> list[list]:
        rows = []
        for f in files:
            text, base = f["text"] or "", (f["path"] or "").rpartition("/")[2]
            is_file = bool(named.search(base))
            lines = [terms(line) for line in text.split("\n")]
            found = [m for words in lines if (m := matcher.best(words, threshold))] + matcher.best_run(lines, threshold)
            if is_file and (m := matcher.best(terms(text), threshold)):
                found.append(m)
            contained = {CONTAINS.get(name) for name, _ in found}
            found = [m for m in found if m[0] not in contained]
            if is_file and (m := whole.best(terms(text), threshold)):
                found = [m]
            best = min(found, key=lambda m: (-round(m[1], 9), m[0]), default=(None, None))
            rows.append((*best, None if best[0] is None else "file" if is_file else "header"))
        return [[r[k] for r in rows] for k in range(3)]

    own = derive(picked.select("doc_id", "path", F.struct("path", "text").alias("_file")), "_file", match, "license string, score double, how string")
    own = materialize(own, "licenses")
    own = own.withColumn("dir", F.when(F.col("path").isNotNull(), F.when(F.instr("path", "/") > 0, F.regexp_replace("path", r"/[^/]*$", "")).otherwise("")))
    given = own.where("how = 'file'").groupBy("dir").agg(F.min_by(F.struct("license", "score"), F.struct(-F.col("score"), "path")).alias("g"))
    given = given.select(F.col("dir").alias("ancestor"), F.col("g.license").alias("dir_license"), F.col("g.score").alias("dir_score"))
    parts = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    dirs = own.where("dir is not null").select("dir").distinct()
    nearest = dirs.withColumn("ancestor", F.explode(ancestors)).join(given, "ancestor").groupBy("dir").agg(F.max_by(F.struct("ancestor", "dir_license", "dir_score"), F.length("ancestor")).alias("d"))
    out = own.join(nearest, "dir", "left")
    inherits = F.col("license").isNull() & F.col("d").isNotNull()
    return out.select(
        "doc_id",
        "path",
        F.coalesce("license", "d.dir_license").alias("license"),
        F.when(inherits, "inherited").otherwise(F.col("how")).alias("how"),
        F.round(F.coalesce("score", F.when(inherits, F.col("d.dir_score"))), 6).alias("score"),
        F.when(inherits, F.col("d.ancestor")).alias("license_dir"),
    )
