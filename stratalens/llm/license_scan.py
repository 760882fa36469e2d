"""Licences by sparse TF-IDF cosine to templates, and by inheritance from directories.

Every line of a document is compared with the templates and notices, and every document as a whole with
them as a licence file. Blocks are compared as well: of each line with a cue (below) and those after it, as
many tokens as a notice has, for each notice's length. So a header is found that is wrapped or lies in a
longer text. Weights are ``(1 + ln tf) * idf``; the inverse document frequencies of the
templates' tokens are counted over all lines of the corpus, any other token weighs as one never seen. Only
units that hold a rare enough token are compared: for each template the tokens are taken from the rarest
on until what is left could not reach the threshold alone, so no unit that could match is missed. Cosines
are summed within the row, by array functions over the sorted tokens: no term is exploded or
shuffled, and a cued line costs the same number of bounded blocks wherever and how often it stands.

A document takes the licence of its best line; a licence file is a document whose whole text
matches. Other documents take that of the nearest directory above them that holds a licence file: their
paths are exploded into all ancestors and joined with the files' directories.

Only DataFrame functions are used. Null and empty texts match nothing and may inherit. Documents
without a path inherit nothing. Equal cosines go to the first template by name, then the first line;
of several files in a directory the best one counts. Repeated rows, and rows that share an id, are rows of
their own. A very long text is read in one task, in time that grows with its length. An empty table gives no rows.
Other columns are read only by the given path.
"""

from __future__ import annotations

import json
import math
import re
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.let import let
from .common import spread, stored

LINE_COSINE = 0.6
FILE_COSINE = 0.6
WORD = r"[^a-z0-9.]+"
#: Places in the table of the templates' tokens.
PLACES = 1024

#: One line for each licence. Fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met:"
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted"
    ),
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

_DISCLAIMER = (
    "the software is provided as is without warranty of any kind express or implied including but not "
    "limited to the warranties of merchantability fitness for a particular purpose and noninfringement in "
    "no event shall the authors or copyright holders be liable for any claim damages or other liability "
    "whether in an action of contract tort or otherwise arising from out of or in connection with the "
    "software or the use or other dealings in the software"
)
_CONDITIONS = (
    "redistribution and use in source and binary forms with or without modification are permitted provided "
    "that the following conditions are met redistributions of source code must retain the above copyright "
    "notice this list of conditions and the following disclaimer redistributions in binary form must "
    "reproduce the above copyright notice this list of conditions and the following disclaimer in the "
    "documentation and or other materials provided with the distribution"
)
#: Published headers and short licence texts, several to a licence. Of the long licences the header and
#: the opening. Fixed values.
NOTICES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
        "in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
        "language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR "
        "USE, REPRODUCTION, AND DISTRIBUTION",
    ),
    "BSD-3-Clause": (
        _CONDITIONS + " neither the name of the copyright holder nor the names of its contributors may be "
        "used to endorse or promote products derived from this software without specific prior written "
        "permission",
    ),
    "BSD-2-Clause": (_CONDITIONS,),
    "CC-BY-NC-4.0": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should "
        "have received a copy of the GNU General Public License along with this program. If not, see "
        "https://www.gnu.org/licenses/",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. "
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing "
        "it is not allowed.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
        "fee is hereby granted, provided that the above copyright notice and this permission notice appear "
        "in all copies.",
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this "
        "permission notice shall be included in all copies or substantial portions of the Software. "
        + _DISCLAIMER,
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
        "the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
        "modify, publish, use, compile, sell, or distribute this software, either in source code form or as "
        "a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
}


def tokens(text: str) -> list[str]:
    return [t for t in (t.strip(".") for t in re.split(WORD, text.lower())) if t]


def _tokens(text: Column) -> Column:
    found = F.transform(F.split(F.lower(text), WORD), lambda t: F.btrim(t, F.lit(".")))
    return F.filter(found, lambda t: t != "")


def weight(tf: int, idf: float) -> float:
    return (1 + math.log(tf)) * idf


def template_weights(idf: dict[str, float], templates: dict[str, str]) -> dict[str, dict[str, float]]:
    """Unit vectors of the templates."""
    out = {}
    for name, text in templates.items():
        found = tokens(text)
        raw = {t: weight(found.count(t), idf[t]) for t in set(found)}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        out[name] = {t: w / norm for t, w in raw.items()}
    return out


def signature(vectors: dict[str, dict[str, float]], threshold: float) -> list[str]:
    """Tokens one of which any unit within the threshold of a template holds."""
    out = set()
    for vector in vectors.values():
        left = 1.0
        for token, w in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
            if left < threshold * threshold - 1e-9:
                break
            out.add(token)
            left -= w * w
    return sorted(out)


def _idf(lines: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """Of the templates' tokens, by the number of lines that hold them; "" for any other token."""
    known = F.array(*[F.lit(t) for t in vocabulary])
    # the empty token, which no line holds, counts the lines in the same pass
    held = F.concat(F.array_intersect("tokens", known), F.array(F.lit("")))
    counts = lines.select(F.explode(held).alias("token")).groupBy("token").count()
    counts = {r["token"]: r["count"] for r in counts.collect()}
    n = counts.pop("", 0)
    idf = lambda df: math.log((n + 1) / (df + 1)) + 1
    return {t: idf(counts.get(t, 0)) for t in vocabulary} | {"": idf(0)}


def _place(token: Column) -> Column:
    return (F.crc32(token) % PLACES).cast("int")


def _entries(idf: dict[str, float], vectors: dict[str, dict[str, float]]) -> Column:
    """A constant: at the place of each token of the templates its ``idf`` and its entry in every template.
    Its size is that of the templates."""
    table: list[list[dict]] = [[] for _ in range(PLACES)]
    for t, w in idf.items():
        if t:
            row = {"t": t, "idf": w, "e": [v.get(t, 0.0) for v in vectors.values()]}
            table[zlib.crc32(t.encode()) % PLACES].append(row)
    kind = "at array<array<struct<t: string, idf: double, e: array<double>>>>"
    return F.from_json(F.lit(json.dumps({"at": table})), kind)["at"]


class _Cosines:
    """Cosines of arrays of tokens to all templates, within the row: time is that of sorting the tokens."""

    def __init__(self, idf: dict[str, float], vectors: dict[str, dict[str, float]]):
        self.entries = _entries(idf, vectors)
        self.unseen = F.lit(idf[""])
        self.names = F.array(*[F.lit(n) for n in vectors])
        self.zeros = F.array_repeat(F.lit(0.0), len(vectors))

    def _entry(self, token: Column) -> Column:
        return F.get(F.filter(F.get(self.entries, _place(token)), lambda e: e["t"] == token), F.lit(0))

    def reaches(self, tokens: Column, threshold: float) -> Column:
        """False if no part of ``tokens`` can be within the threshold of a template: the entries of the
        tokens held bound the cosine, whatever the weights."""
        found = F.filter(F.transform(F.array_distinct(tokens), self._entry), lambda e: e.isNotNull())
        mass = F.aggregate(found, self.zeros, lambda a, e: F.zip_with(a, e["e"], lambda m, x: m + x * x))
        return F.exists(mass, lambda m: m >= (threshold - 1e-6) ** 2)

    def best(self, tokens: Column, threshold: float) -> Column:
        """``less`` (the negated cosine) and ``name`` of the nearest template within the threshold, or null."""

        def runs(ordered: Column) -> Column:
            new = lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1))
            starts = F.filter(F.transform(ordered, lambda x, i: i), new)
            return let(starts, lambda s: F.transform(s, lambda at, j: weighed(ordered, s, at, j)))

        def weighed(ordered: Column, starts: Column, at: Column, j: Column) -> Column:
            tf = F.coalesce(F.get(starts, j + 1), F.size(ordered)) - at
            entry = self._entry(F.get(ordered, at))
            w = lambda e: (1 + F.log(tf)) * F.coalesce(e["idf"], self.unseen)
            return let(entry, lambda e: F.struct(w(e).alias("w"), e["e"].alias("e")))

        def nearest(cells: Column) -> Column:
            square = F.aggregate(cells, F.lit(0.0), lambda a, c: a + c["w"] * c["w"])
            held = F.filter(cells, lambda c: c["e"].isNotNull())
            add = lambda a, c: F.zip_with(a, c["e"], lambda d, x: d + c["w"] * x)
            dots = F.aggregate(held, self.zeros, add)
            return let(F.sqrt(square), lambda norm: F.array_min(F.filter(
                F.zip_with(dots, self.names, lambda d, n: F.struct((-F.round(d / norm, 6)).alias("less"), n.alias("name"))),
                lambda x: x["less"] <= -threshold,
            )))

        return let(F.array_sort(tokens), lambda ordered: let(runs(ordered), nearest))


def _unit(best: Column, at: Column, kind: str) -> Column:
    """In the order of preference: cosine, name, line, and of equals the line before the block. A vector's name is
    that of its licence and a number."""
    license = F.substring_index(best["name"], "#", 1)
    block = F.lit(kind != "line")
    unit = F.struct(best["less"].alias("less"), license.alias("license"), at.alias("unit"), block.alias("block"))
    return F.when(best.isNotNull(), unit)


def _matches(text: Column, cue: str, cosines: _Cosines, lengths: list[int], line_cosine: float, file_cosine: float) -> Column:
    """``own`` (the best line or block) and ``file`` (the whole text's template) of a text."""
    least = min(line_cosine, file_cosine)
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(
        i.alias("at"), _tokens(x).alias("t"), F.lower(x).rlike(cue).alias("cued")))
    lines = F.filter(lines, lambda x: F.size(x["t"]) > 0)

    def blocks(rest: Column, at: Column) -> Column:
        cuts = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(m).alias("m")) for m, n in zip([0, *lengths], lengths)])
        # a length beyond the text's end gives the block of the length before
        cuts = F.filter(cuts, lambda c: c["m"] < F.size(rest))
        one = lambda c: _unit(cosines.best(F.slice(rest, F.lit(1), c["n"]), line_cosine), at, "block")
        return F.when(cosines.reaches(rest, line_cosine), F.array_min(F.transform(cuts, one)))

    def found(lines: Column, parts: Column) -> Column:
        starts = F.transform(lines, lambda x, i: F.struct(x["at"].alias("at"), i.alias("nth"), x["cued"].alias("cued")))
        starts = F.filter(starts, lambda x: x["cued"])
        own = F.transform(starts, lambda s: _unit(cosines.best(F.get(parts, s["nth"]), line_cosine), s["at"], "line"))
        if lengths:
            # a line has one token at least
            rest = lambda s: F.flatten(F.slice(parts, s["nth"] + 1, F.lit(max(lengths))))
            more = F.transform(starts, lambda s: let(rest(s), lambda r: blocks(r, s["at"])))
            own = F.concat(own, more)
        whole = cosines.best(F.flatten(parts), file_cosine)
        return F.struct(F.array_min(own).alias("own"), let(whole, lambda b: _unit(b, F.lit(-1), "line")).alias("file"))

    def looked(lines: Column) -> Column:
        parts = F.transform(lines, lambda x: x["t"])
        return let(parts, lambda p: F.when(cosines.reaches(F.flatten(p), least), found(lines, p)))

    # a text without a cue has no line with one
    return F.when(F.lower(text).rlike(cue), let(lines, looked))


def licenses(
    docs: DataFrame,
    path: Column,
    templates: dict[str, str] = TEMPLATES,
    notices: dict[str, tuple[str, ...]] = NOTICES,
    line_cosine: float = LINE_COSINE,
    file_cosine: float = FILE_COSINE,
) -> DataFrame:
    """``doc_id, license, origin`` (line, block, file, inherited or null)``, cosine, line`` (of a line's match)
    ``, directory`` (that a licence is inherited from), a row for each document. ``path`` has ``/``."""
    rows = spread(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), path.alias("path"))
    lines = rows.select(F.explode(F.split("text", "\n")).alias("line"))
    templates = templates | {f"{n}#{i}": x for n, some in notices.items() for i, x in enumerate(some)}
    vocabulary = sorted({t for x in templates.values() for t in tokens(x)})
    idf = _idf(lines.select(_tokens(F.col("line")).alias("tokens")), vocabulary)
    vectors = template_weights(idf, templates)
    cue = rf"\b({'|'.join(re.escape(t) for t in signature(vectors, min(line_cosine, file_cosine)))})\b"
    lengths = sorted({len(tokens(x)) for some in notices.values() for x in some})
    match = _matches(F.col("text"), cue, _Cosines(idf, vectors), lengths, line_cosine, file_cosine)
    found = stored(rows.select("doc_id", "path", match.alias("m")), "license-documents")
    narrow = found.select("doc_id", "path", "m.own", "m.file")

    parent = F.regexp_replace("path", "/[^/]*$", "")
    files = narrow.where("file IS NOT NULL AND path IS NOT NULL").where(F.instr("path", "/") > 0)
    files = files.groupBy(parent.alias("directory")).agg(
        F.min_by("file.license", F.struct("file.less", "file.license")).alias("from_license")
    )
    files = stored(files, "license-directories")
    parts = F.split("path", "/")
    depth = F.size(parts) - 1
    bare = narrow.where("own IS NULL AND file IS NULL AND path IS NOT NULL").where(F.instr("path", "/") > 0)
    ancestors = F.transform(
        F.sequence(F.lit(1), depth),
        lambda k: F.struct(
            k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("directory")
        ),
    )
    above = bare.select("path", F.explode(ancestors).alias("a")).distinct()
    above = above.select("path", "a.*").join(files, "directory")
    nearest = above.groupBy("path").agg(F.max(F.struct("depth", "directory", "from_license")).alias("near"))
    result = narrow.join(nearest, "path", "left")
    inherits = F.col("own").isNull() & F.col("file").isNull()
    near = lambda c: F.when(inherits, F.col(f"near.{c}"))
    return result.select(
        "doc_id",
        F.coalesce("file.license", "own.license", near("from_license")).alias("license"),
        F.when(F.col("file").isNotNull(), "file")
        .when(F.col("own").isNotNull(), F.when(F.col("own.block"), "block").otherwise("line"))
        .when(F.col("near").isNotNull() & inherits, "inherited")
        .alias("origin"),
        (-F.coalesce("file.less", "own.less")).alias("cosine"),
        F.when(F.col("file").isNull(), F.col("own.unit")).alias("line"),
        near("directory").alias("directory"),
    )
