"""Licence scans: fixed phrases, and template markup compiled into automata over words.

A template is plain wording with ``<<beginOptional>> .. <<endOptional>>`` around what may be missing and ``<<var;N>>`` for up
to N replaceable words. Its automaton accepts a run of words when all mandatory wording matches exactly, in order. Words are
runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased, so punctuation and layout don't matter.

Whole licences need their disclaimers; one-line notices have templates of their own. Null and empty texts have no words, no
places, empty labels and score 0. Null ids and repeated rows stay rows; a label that matches twice is told once. Other columns
are ignored, whatever their names; an empty table gives no rows. A text is scanned whole; its automata start only at a
template's first words, so the cost is that of splitting the text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import ALNUM, pieces

PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

_UNDER = "<<beginOptional>>this <<var;3>> is<<endOptional>> <<beginOptional>>released<<endOptional>><<beginOptional>>licensed<<endOptional>><<beginOptional>>distributed<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> "
# Wording of licences, with optional regions and places for names.
_MIT = (
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"software\"), to deal in the software without restriction, including without limitation the rights " "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions: " "the above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the software. " "the software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. " "in no event shall the <<var;12>> be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."
)
_ISC = (
    "permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " "the software is provided \"as is\" and <<var;6>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. " "in no event shall <<var;6>> be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, " "arising out of or in connection with the use or performance of this software."
)
_BSD = (
    "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<beginOptional>>1.<<endOptional>> redistributions of source code must retain the " "<<beginOptional>>above<<endOptional>> copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> redistributions in binary form must reproduce the above copyright notice, " "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = "<<beginOptional>>3.<<endOptional>> neither the name of <<var;12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_WARRANTY = (
    "this software is provided by <<var;12>> \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. " "in no event shall <<var;12>> be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; " "or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, " "even if advised of the possibility of such damage."
)
_APACHE = (
    "licensed under the apache license, version 2.0 (the \"license\"); you may not use this file except in compliance with the license. you may obtain a copy of the license at http<<beginOptional>>s<<endOptional>>://www.apache.org/licenses/license-2.0 " "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an \"as is\" basis, without warranties or conditions of any kind, either express or implied. " "see the license for the specific language governing permissions and limitations under the license."
)
_GPL = (
    "is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms of the gnu <<beginOptional>>lesser<<endOptional>> <<beginOptional>>affero<<endOptional>> general public license as published by the free software foundation" "<<beginOptional>>, either version <<var;1>> of the license, or (at your option) any later version<<endOptional>>"
)
TEMPLATES = (
    ("mit", _UNDER + "mit license"), ("mit", _MIT), ("isc", _ISC), ("bsd-2-clause", _BSD + _BSD_WARRANTY),
    ("bsd-3-clause", _BSD + _BSD_NAMES + _BSD_WARRANTY), ("apache-2.0", _APACHE), ("gpl", _GPL),
    ("apache-2.0", _UNDER + "apache license, version 2.0"),
    (
        "gpl-3.0",
        "licensed under the <<beginOptional>>terms of the<<endOptional>> gnu general public license, <<beginOptional>>either<<endOptional>> version 3 <<beginOptional>>of the license<<endOptional>>",
    ),
    (
        "gpl-2.0",
        "licensed under the <<beginOptional>>terms of the<<endOptional>> gnu general public license, <<beginOptional>>either<<endOptional>> version 2 <<beginOptional>>of the license<<endOptional>>",
    ),
    ("lgpl", "licensed under the <<beginOptional>>terms of the<<endOptional>> gnu lesser general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license, v. 2.0."),
    ("cc-by-4.0", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> cc by 4.0"),
    ("cc-by-sa-4.0", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> cc by-sa 4.0"),
    ("cc-by-nc-4.0", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> cc by-nc 4.0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4.0 international license"),
    ("cc0", "to the extent possible under law, <<var;12>> has waived all copyright and related or neighboring rights to <<var;12>>"),
    ("copyright", "copyright <<beginOptional>>c<<endOptional>> <<var;8>> all rights reserved"),
)

_TABLE = bytes(0x20 if ALNUM[b] else b + 32 if 0x41 <= b < 0x5B else b for b in range(256))


def normal(text: str | bytes) -> list[bytes]:
    data = text.encode() if isinstance(text, str) else text
    return data.translate(_TABLE).split()


@dataclass(frozen=True)
class Automaton:
    """States 0 .. n; ``word[i]`` leads from i to i + 1, None is one of a run of free words; ``skip[i]`` lists states reached from i for free."""

    label: str
    word: tuple[bytes | None, ...]
    skip: tuple[tuple[int, ...], ...]

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.skip[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def match(self, words: list[bytes], at: int) -> int | None:
        """Where the longest accepted run that starts at word ``at`` ends."""
        states, end, final = self.closure({0}), None, len(self.word)
        for i in range(at, len(words) + 1):
            if final in states:
                end = i
            if i == len(words) or not (states := self.closure({s + 1 for s in states if s < final and self.word[s] in (None, words[i])})):
                break
        return end

    @property
    def heads(self) -> set[bytes]:
        """First words; a template that starts with free words starts at its first mandatory word."""
        return {self.word[s] for s in self.closure({0}) if s < len(self.word) and self.word[s] is not None}


def compile_template(label: str, markup: str) -> Automaton:
    word: list[bytes | None] = []
    skip: dict[int, set[int]] = defaultdict(set)
    open_: list[int] = []
    parts = re.split(r"(<<[^>]*>>)", markup)
    while parts and (not parts[0].strip() or parts[0].startswith("<<var")):
        parts.pop(0)
    for part in parts:
        if part == "<<beginOptional>>":
            open_.append(len(word))
        elif part == "<<endOptional>>":
            skip[open_.pop()].add(len(word))
        elif m := re.fullmatch(r"<<var;(\d+)>>", part):
            a = len(word)
            word += [None] * int(m[1])
            for s in range(a, len(word)):
                skip[s].add(len(word))
        elif part.startswith("<<"):
            raise ValueError(f"unknown markup {part}")
        else:
            word += normal(part)
    if open_:
        raise ValueError("an optional region is not closed")
    return Automaton(label, tuple(word), tuple(tuple(sorted(skip[s])) for s in range(len(word) + 1)))


def scan_text(data: bytes, phrases, automata: dict[bytes, list[Automaton]]) -> tuple[int, list[tuple[str, int, int, bool]]]:
    """How many words, and ``(label, first word, end, is template)`` of each match."""
    words = normal(data)
    found: list[tuple[str, int, int, bool]] = []
    joined = b" ".join([b"", *words, b""])
    for phrase, label in phrases:
        needle, size, at, seen, before = b" %s " % phrase.encode(), phrase.count(" ") + 1, -1, -1, 0
        while (at := joined.find(needle, at + 1)) >= 0:
            before += joined.count(b" ", seen + 1, at + 1)
            seen = at
            found.append((label, before - 1, before - 1 + size, False))
    for head, own in automata.items():
        if b" %s " % head in joined:
            for at in (i for i, w in enumerate(words) if w == head):
                found += [(a.label, at, end, True) for a in own if (end := a.match(words, at)) is not None]
    return len(words), found


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """``id_col``, ``n_words`` and ``matches``: label, first word, end (exclusive) and whether a template matched."""
    automata: dict[bytes, list[Automaton]] = defaultdict(list)
    for label, markup in templates:
        a = compile_template(label, markup)
        for head in a.heads:
            automata[head].append(a)
    automata = dict(automata)
    kind = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("template", pa.bool_())]))
    names = ("label", "first", "end", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = [
                scan_text(t.as_buffer().to_pybytes() if t.is_valid else b"", phrases, automata)
                for t in batch.column("text").cast(pa.binary())
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), pa.array([n for n, _ in rows], pa.int64()),
                    pa.array([[dict(zip(names, m)) for m in f] for _, f in rows], kind),
                ],
                names=["id", "n_words", "matches"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(
        run, "id long, n_words long, matches array<struct<label:string,first:bigint,end:bigint,template:boolean>>",
    ).withColumnRenamed("id", id_col)


def op8_licence_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("matches", lambda m: ~m.template)
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda m: m.label))), ",")
    first = F.transform("base", lambda m: m.first)
    rows = rows.withColumn("base", base)
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(first).alias("first_word"),
        F.array_max(first).alias("last_word"), joined(F.col("base")).alias("base_labels"), joined(F.col("matches")).alias("labels"),
        F.when(F.exists("matches", lambda m: m.template), 1.0).when(F.size("base") > 0, 0.5).otherwise(0.0).alias("score"),
    )
