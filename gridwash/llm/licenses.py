"""License scans: passages of texts compared with licence templates.

Texts are normalised to words (letters and digits, A-Z lower-cased). A passage is a run
of words, wherever its lines break; it matches a template if the Dice coefficient of
their sets of word bigrams reaches a threshold t. With a bigrams in the template, Dice
is 2 s / (a + b) for s shared ones of the b in the passage. So at least t a / (2 - t)
are shared, and the passage has at most a (2 - t) / t.
"""

from __future__ import annotations

import bisect
import pathlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridwash.functions.cells import column
from gridwash.llm import words

#: Names and notices of public licences. Whole texts are in licence_texts/.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, '
        "merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC0-1.0": ["Released into the public domain under CC0 1.0 Universal."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
#: Dice coefficient from which a passage matches.
THRESHOLD = 0.8


def all_templates() -> dict[str, list[str]]:
    """The notices, and the whole texts of licences by the names of their files."""
    out = {name: list(texts) for name, texts in TEMPLATES.items()}
    for file in sorted(pathlib.Path(__file__).with_name("licence_texts").glob("*.txt")):
        out.setdefault(file.stem, []).append(file.read_text(encoding="utf-8"))
    return out


def templates_of(table: DataFrame, name_col: str = "name", text_col: str = "text", most: int = 10_000) -> dict[str, list[str]]:
    """Templates from a table of names and texts, at most ``most`` rows, in the order of
    names and texts. Rows without a name or text are left out."""
    known = table.select(column(name_col).alias("name"), column(text_col).alias("text")).dropna().distinct()
    rows = known.orderBy("name", "text").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} templates")
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["name"], []).append(r["text"])
    return out


def _pairs(h: np.ndarray) -> np.ndarray:
    """Hashes of all pairs of neighbouring words."""
    return words.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) if len(h) else h


class Templates:
    """The templates' bigram sets, and an inverted index from bigram to templates.

    A template of one word has no bigrams; it is found as that word.
    """

    def __init__(self, templates: dict[str, list[str]], threshold: float):
        self.names = [n for n, texts in templates.items() for _ in texts]
        self.threshold = threshold
        column = pa.array([t.encode() for texts in templates.values() for t in texts], pa.binary())
        own = []
        for _, _, data, at in words.pieces(column):
            h, row, _, _ = words.hashed(data, at, words.ALNUM)
            own += [h[row == r] for r in range(len(at) - 1)]
        # By word the first template that is this word alone.
        self.single = {int(w[0]): t for t, w in reversed(list(enumerate(own))) if len(w) == 1}
        self.sets = [np.unique(_pairs(w)) for w in own]
        self.size = np.array([len(s) for s in self.sets], np.int64)
        pairs = sorted((int(b), t) for t, s in enumerate(self.sets) for b in s)
        self.bigram = np.array([b for b, _ in pairs], np.uint64)
        self.template = np.array([t for _, t in pairs], np.int64)

    def likely(self, pair: np.ndarray, row: np.ndarray):
        """(row, template) of the rows that hold enough bigrams of a template."""
        lo = np.searchsorted(self.bigram, pair)
        hi = np.searchsorted(self.bigram, pair, "right")
        known = np.flatnonzero(hi > lo)
        n = (hi - lo)[known]
        at = np.repeat(lo[known] - np.cumsum(n) + n, n) + np.arange(n.sum())
        entries, count = max(len(self.bigram), 1), max(len(self.sets), 1)
        every = np.unique(np.repeat(row[known], n) * entries + at)
        both, shared = np.unique(every // entries * count + self.template[every % entries], return_counts=True)
        row, t = both // count, both % count
        enough = shared * (2 - self.threshold) >= self.threshold * self.size[t] - 1e-9
        return row[enough], t[enough]

    def passages(self, pair: np.ndarray, before: np.ndarray, after: np.ndarray, t: int):
        """(Dice, first, last) of the passages of one text that match template ``t``.

        Passages begin and end in a bigram of the template that they hold once: any
        other first or last bigram can be left out without a loss. ``before`` and
        ``after`` have the places of the same bigram before and after each place. As a
        passage ends before its first bigram comes again, no place is in more passages
        of different starts than the template has bigrams.
        """
        size = int(self.size[t])
        inside = np.isin(pair, self.sets[t])
        most = size * (2 - self.threshold) / self.threshold + 1e-9
        out = []
        for first in np.flatnonzero(inside):
            seen = shared = 0
            lo, step = int(first), 2 * size + 16
            while lo < after[first] and seen <= most:
                hi = min(lo + step, int(after[first]))
                new = before[lo:hi] < first
                distinct = seen + np.cumsum(new)
                hit = new & inside[lo:hi]
                both = shared + np.cumsum(hit)
                dice = 2 * both / (distinct + size)
                for j in np.flatnonzero(hit & (dice >= self.threshold)):
                    out.append((float(dice[j]), int(first), lo + int(j)))
                seen, shared, lo, step = int(distinct[-1]), int(both[-1]), hi, step * 2
        return out


def _places(pair: np.ndarray):
    """Places of the same value before (or -1) and after (or the length) each place."""
    order = np.argsort(pair, kind="stable")
    same = pair[order[1:]] == pair[order[:-1]]
    before, after = np.full(len(pair), -1), np.full(len(pair), len(pair))
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    return before, after


def _apart(passages: list[tuple[float, int, int, int]], size: np.ndarray):
    """Passages (-Dice, first, last, template), best first, without those that meet a better one."""
    firsts: list[int] = []
    lasts: list[int] = []
    for p in sorted(passages, key=lambda p: (p[0], -size[p[3]], *p[1:])):
        i = bisect.bisect_right(firsts, p[2])
        if i == 0 or lasts[i - 1] < p[1]:
            firsts.insert(i, p[1])
            lasts.insert(i, p[2])
            yield p


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, list[str]] | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Per document: id, licenses (array of name, score, line, lines), sorted.

    Every run of words of every text is a passage, also in the middle of a line or over
    any number of lines. A passage that meets a better one (of any licence) does not
    count; of equal ones that of the larger template is better, then the earliest and the
    shortest. For each licence the best passage is told, with the line of its first word
    and the lines it spreads over. Without ``templates`` all known ones are compared
    (``all_templates``); see ``templates_of`` for a table of them.

    Null and empty texts have no licence; repeated rows are each scanned; texts without
    words match nothing; an empty table gives no rows; other columns are ignored.
    """
    chosen = all_templates() if templates is None else templates
    shared = docs.sparkSession.sparkContext.broadcast(Templates(chosen, threshold))
    kind = pa.list_(pa.struct([("name", pa.string()), ("score", pa.float64()), ("line", pa.int32()), ("lines", pa.int32())]))

    def scan(batches):
        known = shared.value
        for batch in batches:
            for lo, hi, data, at in words.pieces(batch.column(1)):
                h, row, starts, _ = words.hashed(data, at, words.ALNUM)
                pair = _pairs(h)
                whole = np.flatnonzero(row[1:] == row[:-1])
                bounds = words.word_bounds(row, len(at) - 1)
                breaks = np.flatnonzero(data == 10)
                met: dict[int, list] = {}
                if known.single:
                    for w in np.flatnonzero(np.isin(h, np.array(list(known.single), np.uint64))):
                        d = int(row[w])
                        place = int(w - bounds[d])
                        met.setdefault(d, []).append((-1.0, place, place, known.single[int(h[w])]))
                last = None
                for d, t in zip(*known.likely(pair[whole], row[whole])):
                    if d != last:
                        own = pair[bounds[d] : bounds[d + 1] - 1]
                        before, after = _places(own)
                        last = d
                    found = known.passages(own, before, after, t)
                    met.setdefault(int(d), []).extend((-dice, i, j, int(t)) for dice, i, j in found)
                out = []
                for d in range(hi - lo):
                    best: dict[str, dict] = {}
                    for score, i, j, t in _apart(met.get(d, ()), known.size):
                        name = known.names[t]
                        if name not in best:
                            # The last word of a passage of bigrams comes after its last place.
                            ends = starts[bounds[d] + i], starts[bounds[d] + j + (known.size[t] > 0)]
                            top, first, end = np.searchsorted(breaks, [at[d], *ends])
                            best[name] = {"name": name, "score": -score, "line": int(first - top), "lines": int(end - first) + 1}
                    out.append([best[n] for n in sorted(best)])
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(out, kind)], ["id", "licenses"])

    chosen = docs.select(column(id_col).cast("long"), column(text_col).cast("binary"))
    out = chosen.mapInArrow(scan, "id long, licenses array<struct<name:string,score:double,line:int,lines:int>>")
    return out.select(F.col("id").alias(id_col), "licenses")
