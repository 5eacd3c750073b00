"""License scans by patience alignment with licence templates.

Texts and templates are compared as bare words (lower case, ASCII punctuation as blanks).  Alignment
anchors on words that stand once in both, takes the longest increasing subsequence of the anchors and
aligns the gaps between them in the same way; a gap without such words is cut by equal ends
and aligned by a longest common subsequence.  Coverage is the matched share of a template.

A passage is a stretch of at most ``1 + slack`` times the template's words (one extra word for each of the template by default), so
words scattered over a text are no licence.  A stretch begins at every word of the text that the template has, which keeps the
result independent of the place; it is aligned unless its words, as a bag, cannot match more than the best passage so far.  So the
work grows with the text and the template's length.  Some templates name words that must be among the matched ones (``NEEDED``): without
"nc" a notice is no CC-BY-NC, without "3" no GPL-3.0.  The reported span ends at the first word by which so many words can be
matched, and starts as late as that end allows.

Defined cases: null and empty texts have no hit; an empty template matches nothing; repeated rows and
templates are treated each by itself; of equal coverages the first place counts; an empty table gives
no row; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplexflow.llm.decontaminate import bare

#: Short notices by which texts state their licence; fixed values, public wording.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
                         "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
                  "(the \"Software\"), to deal in the Software without restriction",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
                  "by the Free Software Foundation",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "reserved": "All rights reserved.",
}
#: Words without which a template is not the one meant, though its other words stand there.
NEEDED = {
    "Apache-2.0": {"apache", "2"},
    "Apache-2.0-notice": {"apache"},
    "MIT": {"mit"},
    "GPL-3.0": {"gnu", "3"},
    "GPL-notice": {"gnu"},
    "CC-BY-NC-4.0": {"cc", "nc", "4"},
    "CC-BY-4.0": {"creative", "commons", "attribution", "4"},
}
SMALL = 4096


def increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence."""
    tails: list[int] = []
    at: list[int] = []
    back = []
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
        back.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence by the plain table, for small gaps."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def sparse_common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence by the equal pairs alone: the places in ``b`` of each word of ``a``, last first, have it as
    a longest increasing subsequence."""
    places: dict[str, list[int]] = {}
    for k in range(len(b) - 1, -1, -1):
        places.setdefault(b[k], []).append(k)
    pairs = [(i, k) for i, w in enumerate(a) for k in places.get(w, ())]
    return [pairs[x] for x in increasing([k for _, k in pairs])]


def tight(a: list[str], b: list[str], n: int) -> tuple[int, int]:
    """The part of ``a`` with the first end, then the last start, that has ``n`` words in common with ``b`` in order."""
    end = bisect_left(range(len(a)), n, key=lambda e: len(sparse_common(a[:e], b)))
    start = bisect_left(range(end), 1, key=lambda s: len(sparse_common(a[s:end], b)) < n) - 1
    return start, end


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places of ``a`` and ``b``, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i2, j, j2 = todo.pop()
        while i < i2 and j < j2 and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i2 and j < j2 and a[i2 - 1] == b[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            out.append((i2, j2))
        if i == i2 or j == j2:
            continue
        in_a, in_b = Counter(a[i:i2]), Counter(b[j:j2])
        place = {w: k for k, w in enumerate(b[j:j2], j) if in_b[w] == 1 and in_a.get(w) == 1}
        anchors = [(k, place[w]) for k, w in enumerate(a[i:i2], i) if w in place]
        if anchors:
            chosen = [anchors[k] for k in increasing([q for _, q in anchors])]
            p, q = i, j
            for x, y in [*chosen, (i2, j2)]:
                todo.append((p, x, q, y))
                if (x, y) != (i2, j2):
                    out.append((x, y))
                p, q = x + 1, y + 1
        else:
            exact = common if (i2 - i) * (j2 - j) <= SMALL else sparse_common
            out += [(i + x, j + y) for x, y in exact(a[i:i2], b[j:j2])]
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float, slack: float = 1.0, needed: dict[str, set[str]] | None = None):
        self.templates = [(name, words, Counter(words), (needed or {}).get(name, set())) for name, text in sorted(templates.items())
                          if (words := bare(text).split())]
        self.threshold = threshold
        self.slack = slack

    def passage(self, hits: list[int], own: list[str], template: list[str], counts: Counter, needed: set[str]) -> tuple[int, int, int]:
        """Words matched by the best passage, at least the threshold (else 0), and its part of ``own``."""
        least = max(1, int(-(-self.threshold * len(template) // 1)))
        reach = len(template) + int(self.slack * len(template))
        have: Counter = Counter()
        bag = end = 0
        best = (0, 0, 0)
        for start, place in enumerate(hits):
            while end < len(hits) and hits[end] < place + reach:
                bag += have[own[end]] < counts[own[end]]
                have[own[end]] += 1
                end += 1
            if bag >= max(least, best[0] + 1) and all(have[w] for w in needed):
                pairs = patience(own[start:end], template)
                if len(pairs) >= max(least, best[0] + 1) and needed <= {template[j] for _, j in pairs}:
                    best = (len(pairs), start, end)
            have[own[start]] -= 1
            bag -= have[own[start]] < counts[own[start]]
        return best

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """Licence, coverage and word span (end excluded) of the best passage of each template that reaches the threshold."""
        words = bare(text).split()
        seen = set(words)
        out = []
        for name, template, counts, needed in self.templates:
            if not needed <= seen or sum(n for w, n in counts.items() if w in seen) < self.threshold * len(template):
                continue
            hits = [i for i, w in enumerate(words) if w in counts]
            own = [words[i] for i in hits]
            n, first, last = self.passage(hits, own, template, counts, needed)
            if n:
                start, end = tight(own[first:last], template, n)
                out.append((name, n / len(template), hits[first + start], hits[first + end - 1] + 1))
        return out


HITS = "array<struct<license:string,coverage:double,start_word:int,end_word:int>>"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text",
         slack: float = 1.0, needed: dict[str, set[str]] | None = None) -> DataFrame:
    """One row per document and licence: ``doc_id, license, coverage, start_word, end_word`` (bare words, end excluded).

    ``needed`` are words that must be matched, by template; by default those of ``NEEDED``, for given ``templates`` none.
    """
    scanner = Scanner(TEMPLATES if templates is None else templates, threshold, slack, NEEDED if templates is None and needed is None else needed)

    @F.pandas_udf(HITS)
    def hits(texts: pd.Series) -> pd.Series:
        names = ("license", "coverage", "start_word", "end_word")
        return pd.Series([[dict(zip(names, h)) for h in scanner.scan(t)] for t in texts], dtype=object)

    found = docs.select(F.col(doc_id).alias("doc_id"), hits.asNondeterministic()(F.col(text)).alias("hits"))
    return found.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")
