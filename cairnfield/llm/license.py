"""License notices by template-markup matching.

A template is written in a small markup: plain words are mandatory, ``<<beginOptional>> … <<endOptional>>`` wraps
words that may be missing, and ``<<var;name;min;max>>`` stands for min to max words of any kind. Templates are
compiled into one token automaton. A text carries a template's label where a run of its words is accepted, that is
where all mandatory wording stands exactly and in order.

Words are maximal runs of characters other than ASCII punctuation, white space and controls, with A-Z lower-cased.
Defined cases: a null text counts as empty, with no words, no labels and score 0; an empty table gives an empty
result; repeated rows stay repeated; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield.llm.common import lean_batches

#: Words, before A-Z are lower-cased: the class is closed under that mapping.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}

# Phrases of the base rule and their labels.
PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}

# Wording of license notices, in the markup.
_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
_SOURCE = "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
_BINARY = "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD = f"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<var;bullet;0;1>> {_SOURCE} <<var;bullet;0;1>> {_BINARY}"
_NEITHER = "neither the name of <<var;holder;1;12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_FREE = "is free software you can redistribute it and or modify it under the terms of the gnu"
_BY_FSF = "general public license as published by the free software foundation"
TEMPLATES = {
    "mit": [
        "<<beginOptional>>released <<beginOptional>>under<<endOptional>> <<endOptional>>under the mit license",
        "licensed under the mit license",
        "spdx license identifier mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
        "<<beginOptional>> including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
        f"<<beginOptional>> the above copyright notice and this permission notice <<beginOptional>>including the next paragraph <<endOptional>>shall be included in all copies or substantial portions of the software<<beginOptional>> {_WARRANTY}<<endOptional>><<endOptional>><<endOptional>>",
    ],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "spdx license identifier isc"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-2-clause": [_BSD, "spdx license identifier bsd 2 clause"],
    "bsd-3-clause": [f"{_BSD} <<var;bullet;0;1>> {_NEITHER}", "spdx license identifier bsd 3 clause"],
    "apache-2.0": [
        "licensed under the <<beginOptional>>terms of the <<endOptional>>apache license <<beginOptional>>version <<endOptional>>2 0",
        "licensed under the apache license version 2 0 the license you may not use <<beginOptional>>this file <<endOptional>>except in compliance with the license you may obtain a copy of the license at <<var;address;1;10>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        "spdx license identifier apache 2 0",
    ],
    "gpl-3.0": [
        "licensed under the <<beginOptional>>terms of the <<endOptional>>gnu general public license <<beginOptional>>as published by the free software foundation <<endOptional>><<beginOptional>>either <<endOptional>>version 3",
        f"{_FREE} {_BY_FSF} either version 3 of the license<<beginOptional>> or at your option any later version<<endOptional>>",
        "spdx license identifier gpl 3 0",
    ],
    "gpl-2.0": [
        "licensed under the <<beginOptional>>terms of the <<endOptional>>gnu general public license <<beginOptional>>as published by the free software foundation <<endOptional>><<beginOptional>>either <<endOptional>>version 2",
        f"{_FREE} {_BY_FSF} either version 2 of the license<<beginOptional>> or at your option any later version<<endOptional>>",
        "spdx license identifier gpl 2 0",
    ],
    "gpl-any": ["redistribute it and or modify it under the terms of the gnu <<beginOptional>>lesser <<endOptional>>general public license"],
    "lgpl": [f"{_FREE} lesser {_BY_FSF} either version <<var;version;1;2>> of the license<<beginOptional>> or at your option any later version<<endOptional>>", "spdx license identifier lgpl <<var;version;1;1>> <<var;minor;1;1>>"],
    "agpl-3.0": [f"{_FREE} affero {_BY_FSF} either version 3 of the license<<beginOptional>> or at your option any later version<<endOptional>>", "spdx license identifier agpl 3 0"],
    "mpl-2.0": ["subject to the terms of the mozilla public license v 2 0<<beginOptional>> if a copy of the mpl was not distributed with this file you can obtain one at <<var;address;1;8>><<endOptional>>", "spdx license identifier mpl 2 0"],
    "epl-2.0": ["made available under the terms of the eclipse public license <<beginOptional>>v <<endOptional>>2 0", "spdx license identifier epl 2 0"],
    "zlib": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "bsl-1.0": ["distributed under the boost software license version 1 0", "spdx license identifier bsl 1 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain<<beginOptional>> anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means<<endOptional>>"],
    "cc-by-4.0": ["licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>>cc by 4 0", "licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc-4.0": ["licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>>cc by nc 4 0", "licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-sa": ["licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>>cc by sa <<var;version;1;1>> 0", "licensed under a creative commons attribution sharealike <<var;version;1;1>> 0 <<var;place;1;2>> license"],
    "cc-by-nd": ["licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>>cc by nd <<var;version;1;1>> 0", "licensed under a creative commons attribution noderivatives <<var;version;1;1>> 0 <<var;place;1;2>> license"],
    "cc0": ["cc0 1 0 universal", "dedicated to the public domain under cc0"],
    "copyright": ["copyright <<beginOptional>>c <<endOptional>><<var;year and holder;1;8>> all rights reserved"],
}

_MARK = re.compile(r"<<(beginOptional|endOptional|var;[^;<>]*;\d+;\d+)>>|([^<\s]+)")


class Automaton:
    """States are numbers. ``step[s]`` maps a word to next states; ``wild[s]`` are next states on any word."""

    def __init__(self, templates: dict[str, list[str]]):
        self.step: list[dict[str, set[int]]] = []
        self.wild: list[set[int]] = []
        self.skip: list[set[int]] = []
        self.label: dict[int, str] = {}
        starts = []
        for name, texts in templates.items():
            for text in texts:
                start = self._state()
                starts.append(start)
                self.label[self._compile(text, start)] = name
        self._close()
        self.first: dict[str, frozenset[int]] = {}
        for s in {x for start in starts for x in self.closure[start]}:
            for word, to in self.step[s].items():
                self.first[word] = self.first.get(word, frozenset()) | {y for t in to for y in self.closure[t]}

    def _state(self) -> int:
        self.step.append({})
        self.wild.append(set())
        self.skip.append(set())
        return len(self.step) - 1

    def _compile(self, text: str, at: int) -> int:
        opened = []
        for mark, word in _MARK.findall(text):
            if mark == "beginOptional":
                opened.append(at)
            elif mark == "endOptional":
                self.skip[opened.pop()].add(at)
            elif mark:
                low, high = map(int, mark.split(";")[2:])
                exits = [at] if low == 0 else []
                for k in range(1, high + 1):
                    to = self._state()
                    self.wild[at].add(to)
                    at = to
                    exits += [at] if k >= low else []
                for s in exits[:-1]:
                    self.skip[s].add(at)
            else:
                to = self._state()
                self.step[at].setdefault(word, set()).add(to)
                at = to
        return at

    def _close(self) -> None:
        self.closure = []
        for s in range(len(self.step)):
            seen, todo = {s}, [s]
            while todo:
                for t in self.skip[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            self.closure.append(frozenset(seen))

    def accept(self, words: list[str]) -> list[tuple[int, int, str]]:
        """(first word, word after the last, label): for each start and label the longest accepted run."""
        found = []
        for i, word in enumerate(words):
            now, best, k = self.first.get(word), {}, i + 1
            while now:
                for s in now:
                    if s in self.label:
                        best[self.label[s]] = k
                if k == len(words):
                    break
                to = {t for s in now for t in self.wild[s]}
                for s in now:
                    to |= self.step[s].get(words[k], set())
                now = {y for t in to for y in self.closure[t]}
                k += 1
            found += [(i, end, label) for label, end in best.items()]
        return found


AUTOMATON = Automaton(TEMPLATES)



def mandatory(template: str) -> set[str]:
    """The words of a template outside all optional regions."""
    found, depth = set(), 0
    for mark, word in _MARK.findall(template):
        depth += (mark == "beginOptional") - (mark == "endOptional")
        if word and not depth:
            found.add(word)
    return found


def _needed() -> re.Pattern:
    """Words of which every template and phrase has one, so other texts need only be counted: a greedy cover by long words."""
    every = [mandatory(t) for texts in TEMPLATES.values() for t in texts]
    # Short words are common in any text; a phrase of short words only is looked up by its first.
    left = [{w for w in ws if len(w) >= 7} for ws in every] + [{w for w in p if len(w) >= 7} or {p[0]} for p in PHRASES]
    if not all(left):
        raise ValueError("a template needs a mandatory word of seven letters or more")
    chosen = []
    while left:
        best = max(sorted({w for ws in left for w in ws}), key=lambda w: (sum(any(w in x for x in ws) for ws in left), len(w)))
        chosen.append(best)
        left = [ws for ws in left if not any(best in x for x in ws)]
    return re.compile("|".join(map(re.escape, chosen)), re.I | re.A)


_NEEDED = _needed()


def scan(text: str) -> tuple[int, int, int | None, int | None, list[str], list[str], list[tuple[int, int, str]]]:
    """n_words, n_base, first and last base word, base labels, all labels, accepted runs."""
    if not _NEEDED.search(text):
        return sum(1 for _ in _WORD.finditer(text)), 0, None, None, [], [], []
    words = [w.translate(_LOWER) for w in _WORD.findall(text)]
    places, base = [], set()
    for i, w in enumerate(words):
        if w in ("cc", "general", "all"):
            for phrase, label in PHRASES.items():
                if w == phrase[0] and tuple(words[i : i + len(phrase)]) == phrase:
                    places.append(i)
                    base.add(label)
    runs = AUTOMATON.accept(words)
    labels = sorted(base | {r[2] for r in runs})
    return len(words), len(places), min(places, default=None), max(places, default=None), sorted(base), labels, runs


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "runs")
    run = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())])
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(run))
    for batch in batches:
        rows = [scan(t.as_py() or "") for t in batch.column(1)]
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        cols[6] = [[{"start": a, "end": b, "label": c} for a, b, c in r] for r in cols[6]]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", *names])


def notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, runs, score) for each row of ``docs``.

    The score grows with the evidence: each accepted run leaves a tenth of the doubt, each base phrase a half.
    """
    only = lean_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = only.schema["doc_id"].dataType.simpleString()
    found = only.mapInArrow(_rows, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, runs array<struct<start:long,end:long,label:string>>")
    doubt = F.pow(F.lit(0.1), F.size("runs")) * F.pow(F.lit(0.5), F.col("n_base"))
    return found.withColumn("score", F.lit(1.0) - doubt)


def op4_license(spark, sf_dir: str) -> DataFrame:
    found = notices(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")
