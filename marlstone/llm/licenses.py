"""License scans with a positional index of rare words, as DataFrame expressions in one scan.

Templates are key phrases, notices and licence texts. The index is one posting list for each of
their rare words: the templates and places where it stands. Of each template it has the places of
the words with the highest inverse document frequency over all documents. A file's words that the
index has are looked up once each, whatever the number of templates; a posting gives (template,
place in the file less place in the template), and where two postings agree, the template's
mandatory key phrase is verified word by word and the share of its words in place is measured.

Nothing is lost by indexing few words: a template of n words counts from a share s of them in
place (all for a key phrase), so at most (1 - s) n of its places differ, and of the (1 - s) n + 2
places in the index at least two agree.

No Python worker and no shuffle of texts: the frequencies are one small count per template word,
and all else happens within a row. Only files that have all words of a key phrase are looked into.

Defined results: a null text counts as empty; texts without words give no places and score 0;
repeated rows and null ids give a row each; on an empty table all frequencies are zero and
the result is empty; other columns pass through, but one named ``license`` is replaced (the
scan's own columns take free names).
"""

from __future__ import annotations

import json
import re
from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.session import free_name, read_table

# Key phrases by label; the first three are the base.
BASE_PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
ADDED_PHRASES = {
    "cc-by-nc": "cc by nc",
    "lgpl": "lesser general public license",
    "agpl": "affero general public license",
    "mpl": "mozilla public license",
    "bsd": "redistribution and use in source and binary forms",
    "mit-text": "permission is hereby granted free of charge",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose",
    "unlicense": "free and unencumbered software released into the public domain",
    "reserved": "all rights reserved",
}
PHRASES = BASE_PHRASES | ADDED_PHRASES
# Notices and texts by the label of the key phrase that is mandatory in them.
TEXTS = {
    "mit": ["Released under the MIT License.", "Licensed under the MIT License."],
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    ],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0."],
    "lgpl": [
        "under the terms of the GNU Lesser General Public License",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License
        as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    ],
    "agpl": ["under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "mpl": ["""This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
        with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""],
    "bsd": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution.""",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder
        nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior
        written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
        EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA,
        OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
        (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
        DAMAGE.""",
    ],
    "mit-text": [
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
        to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
        or substantial portions of the Software.""",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
        to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
        or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
        INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT
        OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "isc-text": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies.""",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
        AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
        EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
        LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
        WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ],
    "unlicense": ["""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means."""],
}
SHARE = 0.75  # of a text's words in place, from which on it counts
PHRASE_SCORE = 0.5  # of a key phrase without a text around it
KELVIN = "\u212a"  # the one character beyond ASCII whose lower case is an ASCII letter
WIDE = 1 << 40  # more than any place in a file: a template's number and where it begins are one number
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"


def cut(text: str) -> list[str]:
    return re.findall(r"[0-9a-z]+", text.lower())


def templates() -> list[dict]:
    """Each with its label, words, the mandatory phrase and its place, and how many words may be out of place."""
    found = [{"label": k, "words": p.split(), "phrase": p.split(), "lead": 0, "off": 0, "text": False} for k, p in PHRASES.items()]
    for label, texts in TEXTS.items():
        phrase = PHRASES[label].split()
        for words in map(cut, texts):
            lead = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
            found.append({"label": label, "words": words, "phrase": phrase, "lead": lead, "off": floor((1 - SHARE) * len(words)), "text": True})
    return found


VOCABULARY = sorted({w for t in templates() for w in t["words"]})
KEY_WORDS = sorted({w for p in PHRASES.values() for w in p.split()})


def words_of(text: str | Column) -> Column:
    """The words of a text column, A to Z in lower case."""
    body = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    lower = F.lower(F.replace(body, F.lit(KELVIN), F.lit("\u2126")))
    return F.array_remove(F.split(lower, SEPARATORS), "")


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def document_frequencies(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """In how many documents each word of the templates stands: a number per template word."""
    found = docs.select(F.explode(F.array_intersect(_strings(VOCABULARY), words_of(text))).alias("word"))
    return dict.fromkeys(VOCABULARY, 0) | {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}


def index(frequencies: dict[str, int]) -> Column:
    """The templates with their places, the rarest word's first, as one constant."""
    rows = []
    for t in templates():
        order = sorted(range(len(t["words"])), key=lambda i: (frequencies[t["words"][i]], t["words"][i], i))  # noqa: B023
        rows.append(t | {"places": [{"word": t["words"][i], "at": i} for i in order]})
    shape = "array<struct<label:string,words:array<string>,phrase:array<string>,lead:int,off:int,text:boolean,places:array<struct<word:string,at:int>>>>"
    return F.from_json(F.lit(json.dumps(rows)), shape)


def _bound(value: Column, use) -> Column:
    """``use(value)``, the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def postings(frequencies: dict[str, int]) -> tuple[list[str], Column]:
    """The words of the index, and word -> array of (template, place) as one number each: a template's rarest places, so many that two must be right."""
    found: dict[str, list[int]] = {}
    for number, t in enumerate(templates()):
        order = sorted(range(len(t["words"])), key=lambda i: (frequencies[t["words"][i]], t["words"][i], i))  # noqa: B023
        for i in order[: t["off"] + 2]:
            found.setdefault(t["words"][i], []).append(number * WIDE - i)
    return sorted(found), F.from_json(F.lit(json.dumps(found)), "map<string,array<bigint>>")


def _twice(offsets: Column) -> Column:
    """The different numbers that stand in an array more than once."""

    def again(own: Column) -> Column:
        return F.array_distinct(F.filter(F.zip_with(own, F.slice(own, 2, F.greatest(F.size(own) - 1, F.lit(0))), lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull()))

    return _bound(F.array_sort(offsets), again)


def _verified(t: Column, words: Column, start: Column) -> Column:
    """The share of the template's words in place, or 0 without its key phrase or with too few of them."""
    key = start + t["lead"]
    whole = (key >= 0) & (F.slice(words, F.greatest(key, F.lit(0)) + 1, F.size(t["phrase"])) == t["phrase"])
    same = F.aggregate(F.transform(t["words"], lambda w, i: F.when((start + i >= 0) & (F.get(words, start + i) == w), 1).otherwise(0)), F.lit(0), lambda a, x: a + x)
    return F.when(whole, _bound(same, lambda n: F.when(n >= F.size(t["words"]) - t["off"], n / F.size(t["words"])).otherwise(0.0))).otherwise(0.0)


def find_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``license``: struct (n_words, places, base_labels, labels, score) to ``docs``.

    ``places`` are (start, label, share, text) of every key phrase and every text, starts counted in words.
    """
    held, hits, found = (free_name(docs, x) for x in ("words", "hits", "places"))
    words = F.col(held)
    out = docs.withColumn(held, words_of(text))
    have = F.array_intersect(_strings(KEY_WORDS), words)
    keys = F.from_json(F.lit(json.dumps([p.split() for p in PHRASES.values()])), "array<array<string>>")
    some = _bound(have, lambda h: F.exists(keys, lambda p: F.size(F.array_except(p, h)) == 0))
    frequencies = document_frequencies(docs, text)
    rare, places = postings(frequencies)
    at = F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at")))
    out = out.withColumn(hits, F.when(some, F.filter(at, lambda h: h["word"].isin(rare))))
    table = index(frequencies)

    def begun(h: Column) -> Column:
        return F.transform(places[h["word"]], lambda p: p + h["at"])

    def placed(code: Column) -> Column:
        number = F.floor((code + WIDE // 2) / WIDE).cast("int")
        return _bound(F.get(table, number), lambda t: _bound((code - number * F.lit(WIDE)).cast("int"), lambda s: F.struct(s.alias("start"), t["label"].alias("label"), _verified(t, words, s).alias("share"), t["text"].alias("text"))))

    codes = _bound(F.flatten(F.transform(F.col(hits), begun)), _twice)
    every = F.array_sort(F.filter(F.transform(codes, placed), lambda x: x["share"] > 0))
    nothing = F.expr("cast(array() as array<struct<start:int,label:string,share:double,text:boolean>>)")
    out = out.withColumn(found, F.coalesce(F.when(F.col(hits).isNotNull(), every), nothing))
    labels = lambda keep: F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter(found, keep), lambda p: p["label"]))), ",")
    score = F.coalesce(F.array_max(F.transform(found, lambda p: F.when(p["text"], p["share"]).otherwise(PHRASE_SCORE))), F.lit(0.0))
    told = F.struct(F.size(words).cast("long").alias("n_words"), F.col(found).alias("places"), labels(_base).alias("base_labels"), labels(lambda p: F.lit(True)).alias("labels"), score.alias("score"))
    return out.withColumn("license", told).drop(held, hits, found)


def _base(place: Column) -> Column:
    """A key phrase of the base."""
    return ~place["text"] & place["label"].isin(*BASE_PHRASES)


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    found = find_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "license.*")
    starts = F.transform(F.filter("places", _base), lambda p: p["start"].cast("long"))
    based = found.withColumn("starts", starts)
    return based.select("doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").alias("first_word"), F.array_max("starts").alias("last_word"), "base_labels", "labels", "score")


def _sql() -> str:
    """Each key phrase at every place, the contract's three written out; each text around its phrase."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    phrases = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"} | ADDED_PHRASES
    name = lambda label: f"at_{label.replace('-', '_')}"
    at, shares = [], []
    for label, phrase in phrases.items():
        own = phrase.split()
        at.append(f"CASE WHEN list_has_all(words, {quoted(own)}) THEN list_filter(range(1, len(words) - {len(own) - 2}), lambda i: words[i:i + {len(own) - 1}] = {quoted(own)}) ELSE [] END AS {name(label)}")
        shares.append(f"CASE WHEN len({name(label)}) > 0 THEN {PHRASE_SCORE} END::DOUBLE")
        for text in TEXTS.get(label, []):
            full = cut(text)
            lead = next(i for i in range(len(full)) if full[i : i + len(own)] == own)
            same = f"len(list_filter(range({len(full)}), lambda i: s + i > {lead} AND words[greatest(s + i - {lead}, 1)] = {quoted(full)}[i + 1]))"
            share = f"list_transform({name(label)}, lambda s: {same} / {len(full)}.0::DOUBLE)"
            shares.append(f"list_max(list_filter({share}, lambda x: x >= {(len(full) - floor((1 - SHARE) * len(full))) / len(full) - 1e-9}))")
    label_list = lambda names: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN len({name(k)}) > 0 THEN '{k}' END" for k in sorted(names)) + "], lambda x: x IS NOT NULL), ',')"
    base = "list_concat(list_concat(at_mit, at_apache), at_gpl)"
    return rf"""
    WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
    p AS (SELECT doc_id, words, {", ".join(at)} FROM w)
    SELECT doc_id, len(words)::BIGINT AS n_words, len({base})::BIGINT AS n_base, list_min({base}) - 1 AS first_word, list_max({base}) - 1 AS last_word,
           {label_list(["mit", "apache", "gpl"])} AS base_labels, {label_list(phrases)} AS labels, coalesce(greatest({", ".join(shares)}), 0)::DOUBLE AS score
    FROM p"""


QUERIES = {"op3_licenses": op3_licenses}
ORACLES = {"op3_licenses": _sql()}
