"""License scans with a positional index of rare words (native).

A fixed table of licence texts, file headers, titles and identifiers is indexed by word and place.  A notice can only
stand where its mandatory key phrases do, so of each notice whose key words a text has, the rarest ones (highest IDF over
the notices) are looked up; each place of such a word, less its place in the notice, is where the notice would begin, and
the beginnings that all looked-up words agree on are kept.  There the key phrases are verified, and the notice is scored by
the IDF mass of its words that stand where they should; it counts if the score is high enough.  No beginning is left out.

Words are runs of digits, letters a-z (after lower-casing A-Z) and characters beyond ASCII.

Defined cases: a null or empty text has no words and no labels (empty strings), null first_word and last_word and score
0.  Repeated rows are scanned each.  An empty table gives an empty result.  Other columns of the input are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import whole

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word before lower-casing.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A word after it.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that are always reported, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label, text and key phrases of well-known public licences and notices.
_NOTICES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "the mit license", ["mit license"]),
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the
        rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit
        persons to whom the software is furnished to do so subject to the following conditions""",
     ["permission is hereby granted free of charge to any person obtaining a copy of this software"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["this permission notice shall be included in all copies or substantial portions"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("apache-2.0", "apache license version 2 0 january 2004", ["apache license version 2"]),
    ("apache-2.0", """licensed under the apache license version 2 0 the license you may not use this file except in compliance
        with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required
        by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
        without warranties or conditions of any kind either express or implied""",
     ["apache license version 2", "you may not use this file except in compliance with the license"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3.0", """this program is free software you can redistribute it and or modify it under the terms of the gnu general
        public license as published by the free software foundation either version 3 of the license or at your option any
        later version""", ["gnu general public license as published by the free software foundation", "either version 3 of the license"]),
    ("gpl-2.0", """this program is free software you can redistribute it and or modify it under the terms of the gnu general
        public license as published by the free software foundation either version 2 of the license or at your option any
        later version""", ["gnu general public license as published by the free software foundation", "either version 2 of the license"]),
    ("gpl-3.0", "under the terms of the gnu general public license as published by the free software foundation version 3", ["gnu general public license as published by the free software foundation version 3"]),
    ("gpl-2.0", "under the terms of the gnu general public license as published by the free software foundation version 2", ["gnu general public license as published by the free software foundation version 2"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("lgpl", """this library is free software you can redistribute it and or modify it under the terms of the gnu lesser
        general public license as published by the free software foundation""", ["lesser general public license as published by the free software foundation"]),
    ("agpl", "licensed under the gnu affero general public license", ["affero general public license"]),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ["affero general public license as published by the free software foundation"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-4.0", "creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by-sa-4.0", "creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike 4 0"]),
    ("cc-by-nc-4.0", "creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial 4 0"]),
    ("cc0", "released under cc0 1 0 universal public domain dedication", ["cc0"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    ("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided that the
        following conditions are met""", ["redistribution and use in source and binary forms"]),
    ("bsd", """redistributions of source code must retain the above copyright notice this list of conditions and the following
        disclaimer""", ["redistributions of source code must retain the above copyright notice"]),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission", ["to endorse or promote products derived from this software"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("mpl-2.0", """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not
        distributed with this file you can obtain one at http mozilla org mpl 2 0""", ["source code form is subject to the terms of the mozilla public license"]),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby
        granted provided that the above copyright notice and this permission notice appear in all copies""",
     ["permission to use copy modify", "distribute this software for any purpose with or without fee"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held
        liable for any damages arising from the use of this software""", ["in no event will the authors be held liable for any damages arising from the use of this software"]),
    ("bsl-1.0", "boost software license version 1 0", ["boost software license"]),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ["eclipse public license"]),
    ("wtfpl", "do what the fuck you want to public license", ["what the fuck you want to public license"]),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited", ["unauthorized copying"]),
]
#: Identifiers that follow "SPDX-License-Identifier:".
_IDENTIFIERS = [
    "MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "Zlib", "Unlicense",
    "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "BSL-1.0", "EPL-2.0", "WTFPL",
]
_LABELS = {"lgpl-2.1": "lgpl", "lgpl-3.0": "lgpl", "agpl-3.0": "agpl", "cc0-1.0": "cc0", "bsd-2-clause": "bsd"}


def _identified(name: str) -> tuple[str, str, list[str]]:
    line = "spdx license identifier " + re.sub("[^a-z0-9]+", " ", name.lower())
    return _LABELS.get(name.lower(), name.lower()), line, [line]


NOTICES = [(label, " ".join(text.split()), keys) for label, text, keys in _NOTICES] + [_identified(x) for x in _IDENTIFIERS]
#: Words looked up for each notice, and the least score of a notice that counts.
ANCHORS, LEAST_SCORE = 3, 0.6


def _index(notices: list[tuple[str, str, list[str]]]) -> list[dict]:
    """Label, words, share of the IDF mass of each word, places of the key phrases, their words, and the anchors (word, place), rarest first."""
    words = [n.split() for _, n, _ in notices]
    held = Counter(w for x in words for w in set(x))
    out = []
    for (label, _, keys), line in zip(notices, words, strict=True):
        idf = {w: math.log((1 + len(notices)) / held[w]) for w in line}
        places = set()
        for phrase in map(str.split, keys):
            at = next(k for k in range(len(line)) if line[k : k + len(phrase)] == phrase)
            places |= set(range(at, at + len(phrase)))
        first = {}
        for k in sorted(places):
            first.setdefault(line[k], k)
        anchors = sorted(first.items(), key=lambda x: (-idf[x[0]], x[1]))[:ANCHORS]
        mass = sum(idf[w] for w in line)
        out.append({"label": label, "words": line, "mass": [idf[w] / mass for w in line], "places": sorted(places), "key": sorted(first), "anchors": anchors})
    return out


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _literal(index: list[dict]) -> Column:
    """The index as one constant."""
    shape = "array<struct<label:string,words:array<string>,mass:array<double>,places:array<int>,key:array<string>,anchors:array<struct<word:string,at:int>>>>"
    rows = [x | {"anchors": [{"word": w, "at": at} for w, at in x["anchors"]]} for x in index]
    return F.from_json(F.lit(json.dumps(rows)), shape)


def _phrase_places(words: Column, phrase: str) -> Column:
    parts = phrase.split()
    last = F.size(words) - len(parts)

    def stands(i: Column) -> Column:
        out = F.get(words, i) == parts[0]
        for k, w in enumerate(parts[1:], 1):
            out = out & (F.get(words, i + k) == w)
        return out

    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), stands)).otherwise(F.array().cast("array<int>"))


def _matches(words: Column, present: Column, notices: Column) -> Column:
    """label, score of every aligned notice with its key phrase.  ``present`` are the known words that the text has."""

    def begins_of(t: Column) -> Column:
        """Where all anchors agree that the notice begins."""
        first, others = F.get(t.anchors, 0), F.slice(t.anchors, 2, ANCHORS)
        begins = F.filter(F.transform(words, lambda w, i: F.when(w == first.word, i - first["at"])), lambda b: b >= -first["at"])
        return F.filter(begins, lambda b: F.forall(others, lambda o: (b + o["at"] >= 0) & F.coalesce(F.get(words, F.greatest(b + o["at"], F.lit(0))) == o.word, F.lit(False))))

    def of_notice(t: Column) -> Column:
        def scored(b: Column) -> Column:
            right = F.transform(t.words, lambda w, j: F.coalesce((b + j >= 0) & (F.get(words, F.greatest(b + j, F.lit(0))) == w), F.lit(False)))
            mass = F.aggregate(F.zip_with(right, t.mass, lambda r, m: F.when(r, m).otherwise(0.0)), F.lit(0.0), lambda a, m: a + m)
            key = F.forall(t.places, lambda j: F.get(right, j))
            return F.struct(t.label.alias("label"), F.when(key, F.least(mass, F.lit(1.0))).otherwise(0.0).alias("score"))

        return F.transform(begins_of(t), scored)

    possible = F.filter(notices, lambda t: F.size(F.array_except(t.key, present)) == 0)
    return F.filter(F.flatten(F.transform(possible, of_notice)), lambda x: x.score >= LEAST_SCORE)


def _gate(low: Column) -> Column:
    """Whether a text in lower case can hold a phrase or notice: a telling word of it, or a short phrase as such."""
    words, patterns = set(), set()
    for phrase in [*PHRASES, *(keys[0] for _, _, keys in NOTICES)]:
        parts = phrase.split()
        telling = "license" if "license" in parts else max(parts, key=len)
        if len(telling) > 3:
            words.add(telling)
        else:
            patterns.add(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+".join(map(re.escape, parts[:2])))
    tests = [F.contains(low, F.lit(w)) for w in sorted(words)] + [low.rlike(p) for p in sorted(patterns)]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _lower(text: Column) -> Column:
    """Lower case that agrees with that of A-Z in all ASCII letters; two other letters would turn into such."""
    return F.when(text.rlike("[\u0130\u212A]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    text = whole(text_col)
    known = sorted({w for p in [*PHRASES, *(key for _, _, keys in NOTICES for key in keys)] for w in p.split()})

    def examined(words: Column, present: Column) -> Column:
        places = [F.when(F.size(F.array_except(F.array(*map(F.lit, p.split())), present)) == 0, _phrase_places(words, p)).otherwise(F.array().cast("array<int>")) for p in PHRASES]
        return F.struct(
            F.array(*[F.size(p) for p in places]).alias("counts"),
            F.array_min(F.concat(*places)).cast("long").alias("first"),
            F.array_max(F.concat(*places)).cast("long").alias("last"),
            _matches(words, present, _literal(_index(NOTICES))).alias("found"),
        )

    texts = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    words = F.regexp_extract_all(F.col("low"), F.lit(WORD), F.lit(0))
    whole_text = _let(words, lambda w: _let(F.array_intersect(F.array(*map(F.lit, known)), w), lambda present: examined(w, present)))
    # ``low`` and ``seen`` are used more than once below, so that the optimizer keeps them as columns of their own.
    lowered = texts.select("doc_id", F.regexp_count("text", F.lit(RAW_WORD)).cast("long").alias("n_words"), _lower(F.col("text")).alias("low"))
    seen = lowered.select("doc_id", "n_words", F.when(_gate(F.col("low")), whole_text).alias("seen"))
    counts = [F.coalesce(F.col("seen.counts")[k], F.lit(0)) for k in range(len(PHRASES))]
    base = F.filter(F.array(*[F.when(c > 0, F.lit(label)) for c, label in zip(counts, PHRASES.values(), strict=True)]), lambda x: x.isNotNull())
    labels = F.array_sort(F.array_union(base, F.coalesce(F.transform("seen.found", lambda x: x.label), F.array().cast("array<string>"))))
    best = F.coalesce(F.array_max(F.transform("seen.found", lambda x: x.score)), F.lit(0.0))
    n_base = sum(counts[1:], counts[0]).cast("long")
    return seen.select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.col("seen.first").alias("first_word"),
        F.col("seen.last").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )
