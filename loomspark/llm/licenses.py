"""License scans by conditional compression.

A candidate block is what stands around a cue word. It is compressed alone and with each template as a raw
Zstandard dictionary; templates are ranked by the bytes that they save, as a share of what their own text
takes. Every one that saves any is confirmed by an alignment of words, whose differences are counted exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.lean import lean

#: Usual wordings of license notices, and the words by which they are found.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Names of licenses by how notices give them; with them, a template for each usual wording.
_GNU = {"GPL": "General Public License", "LGPL": "Lesser General Public License", "AGPL": "Affero General Public License"}
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}


def _usual() -> dict[str, str]:
    """Further usual wordings: a number after # tells apart those of one license."""
    out = {}

    def put(name: str, *texts: str) -> None:
        for text in texts:
            if text not in TEMPLATES.values():
                out[f"{name}#{len(out)}"] = text

    put("MIT-notice", "under the terms of the MIT License", "under the MIT License", "MIT Licensed")
    put("ISC-notice", "under the ISC License")
    put("Apache-2.0-notice", "under the Apache License 2.0", "under the Apache 2.0 License", "Apache License Version 2.0, January 2004")
    for n in (2, 3):
        put(f"BSD-{n}-Clause-notice", f"under the BSD {n}-Clause License", f"under the {n}-Clause BSD License")
    put("BSD-notice", "under the BSD License", "under a BSD-style License")
    put("MPL-2.0-notice", "under the Mozilla Public License 2.0", "under the Mozilla Public License Version 2.0", "subject to the terms of the MPL 2.0")
    for v in ("1.0", "2.0"):
        put(f"EPL-{v}-notice", f"under the Eclipse Public License {v}", f"under the Eclipse Public License Version {v}", f"under the terms of the Eclipse Public License v. {v}", f"under the EPL {v}")
    put("Unlicense-notice", "under the Unlicense")
    for short, versions in {"GPL": ("2", "3"), "LGPL": ("2.1", "3"), "AGPL": ("3",)}.items():
        for v in versions:
            name = f"{short}-{v if '.' in v else v + '.0'}-notice"
            put(name, f"licensed under the GNU {_GNU[short]}, version {v}", f"under the GNU {_GNU[short]} v{v}", f"under the {short} v{v}", f"under the {short} version {v}", f"under the {short}v{v}", f"under the {short}-{v}")
            put(name, f"under the terms of the GNU {_GNU[short]} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version")
            put(name, f"under the terms of the GNU {_GNU[short]} as published by the Free Software Foundation, version {v}", f"GNU {_GNU[short]} Version {v}")
        put(f"{short}-notice", f"under the GNU {_GNU[short]}", f"under the {short}")
    put("LGPL-2.0-notice", "under the GNU Library General Public License, version 2")
    for code, long in _CC.items():
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            put(f"CC-{code}-{v}", f"under CC {code} {v}", f"under CC-{code}-{v}", f"under CC-{code} {v}", f"under a Creative Commons {long} {v} International License", f"under the Creative Commons {long} {v} License")
    put("CC0-1.0", "under CC0 1.0", "under CC0", "under the Creative Commons Zero 1.0 License", "CC0 1.0 Universal Public Domain Dedication")
    return out


#: Words that tell licenses apart: none of them may differ, be left out or added within a notice; nor may versions.
NAMES = frozenset(
    "mit isc apache bsd bsd-style 2-clause 3-clause 4-clause mozilla mpl eclipse epl gnu gpl lgpl agpl lesser library affero cc cc0 zero creative commons unlicense unencumbered boost artistic zlib".split()
    + [w for code in _CC for w in (code.lower(), f"cc-{code.lower()}")]
    + [long.lower() for long in _CC.values()]
)
_VERSION = re.compile(r"v?\.?(\d{1,2}(?:\.\d+)*?)(?:\.0)*")
_NUMBERED = re.compile(r"(?:a|l)?gplv\d|(?:a|l)?gpl-\d|cc-by[a-z-]*-\d|(?:mit|apache|mpl|epl)-\d")
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*((?:[A-Za-z0-9.+()-]+|[ \t]+(?:OR|AND|WITH)[ \t]+|\([ \t]*|[ \t]*\))+)", re.I)
CUES = r"licen[sc]|permission|redistribut|mozilla|creative commons|public domain|cc by|cc-by|cc0|gpl|\bmpl\b|\bepl\b"
_CUE = re.compile(CUES, re.I)
_WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")
#: Words that may differ, as a share of the template's; from four words on at least one may.
DIFFERENT = 0.12
_NEVER = 1 << 16


def _norm(word: str) -> str:
    """A version by its number alone: v3, 3 and 3.0 are one."""
    m = _VERSION.fullmatch(word)
    return m[1] if m else re.sub(r"(?:\.0)+$", "", word) if _NUMBERED.match(word) else word


def _names(words: list[str], named: bool) -> np.ndarray:
    """Which words tell licenses apart: names and versions, where the template names its license at all."""
    return np.array([named and bool(w in NAMES or _VERSION.fullmatch(w) or _NUMBERED.match(w)) for w in words], bool)


def allowed(template: list[str]) -> int:
    """Words of a notice that may differ."""
    return max(len(template) > 3, int(DIFFERENT * len(template)))


@cache
def _tools() -> tuple:
    plain = zstandard.ZstdCompressor(level=3).compress
    found = []
    for name, text in (TEMPLATES | _usual()).items():
        words = [w.lower() for w in _WORD.findall(text)]
        raw = " ".join(words).encode()
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        named = any(w in NAMES or _NUMBERED.match(w) for w in words)
        needs = frozenset(_norm(w) for w, is_name in zip(words, _names(words, named), strict=True) if is_name)
        found.append((name.split("#")[0], words, needs, zstandard.ZstdCompressor(level=3, dict_data=d).compress))
    return plain, found


@cache
def _reach() -> int:
    """Words of the longest notice: the longest template's and those that may be added."""
    return max(len(words) + allowed(words) for _, words, *_ in _tools()[1])


def align(template: list[str], words: list[str]) -> tuple[int, int, int]:
    """(differences, first word, last word + 1) of the part of ``words`` nearest to the template: the fewest insertions, deletions and changes.

    Of equally near parts, the one that ends first, and of these the longest. A difference in a word that tells
    licenses apart counts as more than any template may have.
    """
    ids: dict[str, int] = {}
    t = [ids.setdefault(_norm(w), len(ids)) for w in template]
    x = np.array([ids.get(_norm(w), -1) for w in words], np.int64)
    n = len(x)
    steps = np.arange(n + 1)
    named = any(w in NAMES or _NUMBERED.match(w) for w in template)
    added = np.where(_names(words, named), _NEVER, 1)
    lost = np.where(_names(template, named), _NEVER, 1)
    along = np.r_[0, np.cumsum(added)] << 32
    cost, start = np.zeros(n + 1, np.int64), steps.copy()
    for k, w in enumerate(t, 1):
        # A cell's cost and start in one number, so the least cost with the least start is one minimum.
        both = cost * (1 << 32) + start
        one = 1 << 32
        new = both + int(lost[k - 1]) * one
        new[1:] = np.minimum(new[1:], both[:-1] + np.where(x == w, 0, np.maximum(added, lost[k - 1]) * one))
        # Words of the text that the template lacks: a running minimum along the row.
        new = np.minimum.accumulate(new - along) + along
        cost, start = new >> 32, new & (one - 1)
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end]), end


def blocks(text: str) -> list[tuple[list[str], list[tuple[int, int]]]]:
    """Words and places of the surroundings of cue words; surroundings that meet are one block.

    They reach as far as the longest notice may have words, so a notice around its cue is never cut.
    """
    cues = [m.start() for m in _CUE.finditer(text)]
    if not cues:
        return []
    reach = _reach()
    places = [m.span() for m in _WORD.finditer(text)]
    ends = np.array([e for _, e in places])
    out: list[list[int]] = []
    for c in cues:
        at = int(np.searchsorted(ends, c, side="right"))
        a, b = max(0, at - reach), min(len(places), at + reach)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [([text[s:e].lower() for s, e in places[a:b]], places[a:b]) for a, b in out]


def scan(text: str) -> list[tuple[str, int, int, int]]:
    """(license, start, end, different words) of each notice, in order of place; where notices overlap, the longer one."""
    plain, templates = _tools()
    found = []
    for m in _SPDX.finditer(text):
        for x in re.finditer(r"[A-Za-z0-9.+-]+", m[1]):
            if x[0].upper() not in ("OR", "AND", "WITH"):
                found.append((_NEVER, x[0].rstrip(".") + "-identifier", m.start(1) + x.start(), m.start(1) + x.start() + len(x[0].rstrip(".")), 0))
    for words, places in blocks(text):
        # A long block is compressed by parts, as a window of the longest notice's size is where a notice lies.
        reach = _reach()
        for at in range(0, len(words), reach):
            part, where = words[at : at + 2 * reach], places[at : at + 2 * reach]
            if not any(_CUE.search(w) or w in ("creative", "public", "cc") for w in part):
                continue
            raw = " ".join(part).encode()
            alone, has = len(plain(raw)), {_norm(w) for w in part}
            for name, template, needs, compress in templates:
                # Without its names there is no notice.
                if not needs <= has or len(compress(raw)) >= alone:
                    continue
                rests = [(0, len(part))]
                while rests:  # before and after each notice there may be more of them
                    low, high = rests.pop()
                    wrong, a, b = align(template, part[low:high])
                    if b <= a or wrong > allowed(template):
                        continue
                    found.append((len(template) - wrong, name, where[low + a][0], where[low + b - 1][1], wrong))
                    rests += [(low, low + a), (low + b, high)]
    kept: list[tuple[str, int, int, int]] = []
    for _, name, s, e, wrong in sorted(set(found), key=lambda x: (-x[0], x[4], x[2], x[1])):
        if all(e <= s2 or s >= e2 for _, s2, e2, _ in kept):
            kept.append((name, s, e, wrong))
    return sorted(kept, key=lambda x: x[1])


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("different", pa.int32())]))
    for batch in batches:
        rows = [[dict(zip(("license", "start", "end", "different"), x, strict=True)) for x in (scan(t) if t and _CUE.search(t) else [])] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "notices"])


def scan_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, notices) of each row of ``docs`` (doc_id, text): arrays of (license, start, end, different), code points.

    Whole texts are searched. A null or empty text has no notices. Repeated rows are repeated, a null doc_id is
    kept; an empty table gives no rows. Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    cued = docs.select("doc_id", F.when(F.col("text").rlike("(?i)" + CUES), F.col("text")).alias("text"))
    return cued.mapInArrow(lean(_scanned), f"doc_id {kind}, notices array<struct<license: string, start: int, end: int, different: int>>")
