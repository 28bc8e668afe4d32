"""License scan: exact phrases, and fuzzy search for short notices.

Texts are normalised to their words (A-Z lower-cased) with one space between.
A notice that may have ``e`` edits is split into ``e + 1`` pieces; a place
within ``e`` edits of it holds at least one piece unchanged (pigeonhole), so an
automaton over all pieces finds every candidate place in one pass.  The regex
library's bounded-error matching then verifies each candidate by itself, within
its own text, and gives its span and edits.  Exact phrases go through the same
automaton and must begin and end at words.

Edge cases: a null text is empty; texts without words have no spans and score 0;
a doc_id is passed through as it is, rows are independent, so repeated rows get
equal answers; of notices that overlap the one with the fewest edits holds,
then the longest;
texts of any length are searched whole; an empty table gives an empty result;
columns but the id and the text are not read.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichelab.llm.arrays import IS_WORD, LOWER, Chunk, chunks, spans
from nichelab.llm.common import table

#: Phrases (exact) and notices (fuzzy), as (label, words).
PHRASES = (
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
)
NOTICES = (
    ("agpl", "gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors"),
    ("bsd", "released under the bsd 3 clause license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "cc0 1 0 universal public domain dedication"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl", "mozilla public license version 2 0"),
    ("proprietary", "all rights reserved no part of this"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: One edit for so many characters of a notice, up to MAX_EDITS; a piece is never shorter than MIN_PIECE.
CHARS_PER_EDIT, MAX_EDITS, MIN_PIECE = 12, 5, 6
SPAN_TYPE = "array<struct<label:string,exact:boolean,first_word:bigint,last_word:bigint,edits:int,similarity:double>>"


def allowed_edits(notice: str) -> int:
    return max(0, min(MAX_EDITS, len(notice) // CHARS_PER_EDIT, len(notice) // MIN_PIECE - 1))


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` consecutive pieces as (offset, text)."""
    at = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(at, at[1:], strict=False)]


class Searcher:
    """The automaton over phrases and pieces, and a bounded-error pattern per notice."""

    def __init__(self, phrases=PHRASES, notices=NOTICES):
        self.phrases, self.notices = phrases, notices
        self.edits = [allowed_edits(n) for _, n in notices]
        self.fuzzy = [regex.compile(f"(?b)(?:{regex.escape(n)}){{e<={e}}}") for (_, n), e in zip(notices, self.edits, strict=True)]
        known: dict[str, list[tuple[int, int, int]]] = {}
        for i, (_, phrase) in enumerate(phrases):
            known.setdefault(phrase, []).append((0, i, 0))
        for i, (_, notice) in enumerate(notices):
            for offset, piece in pieces(notice, self.edits[i]):
                known.setdefault(piece, []).append((1, i, offset))
        self.automaton = ahocorasick.Automaton()
        for text, uses in known.items():
            self.automaton.add_word(text, (len(text), uses))
        if known:
            self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(kind, index, start, end, edits) in a normalised text that begins and ends with a break."""
        found: list[tuple[int, int, int, int, int]] = []
        windows: set[tuple[int, int, int]] = set()
        if not len(self.automaton):
            return found
        for last, (length, uses) in self.automaton.iter(text):
            start = last - length + 1
            for kind, i, offset in uses:
                if kind == 0:
                    if text[start - 1] in " \n" and text[last + 1] in " \n":
                        found.append((0, i, start, last + 1, 0))
                    continue
                slack = self.edits[i]
                a = max(0, start - offset - slack)
                b = min(len(text), start - offset + len(self.notices[i][1]) + slack)
                a = max(a, text.rfind("\n", a, start) + 1)
                end = text.find("\n", last, b)
                windows.add((i, a, b if end < 0 else end))
        places: list[tuple[int, ...]] = []

        def look(i: int, a: int, b: int) -> None:
            """The best match in a window; two matches in one window always overlap, since it is little longer than the notice."""
            if b - a >= len(self.notices[i][1]) - self.edits[i] and (m := self.fuzzy[i].search(text, a, b)):
                heapq.heappush(places, (sum(m.fuzzy_counts), m.start() - m.end(), m.start(), m.end(), i, a, b))

        for window in windows:
            look(*window)
        # of notices that overlap, the one with the fewest edits holds, then the longest; beside it the others' windows are searched again
        taken: list[tuple[int, int]] = []
        while places:
            edits, _, start, end, i, a, b = heapq.heappop(places)
            at = bisect.bisect_left(taken, (start, end))
            if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or taken[at][0] >= end):
                taken.insert(at, (start, end))
                found.append((1, i, start, end, edits))
                continue
            at = max(0, bisect.bisect_left(taken, (a, a)) - 1)
            while at < len(taken) and taken[at][0] < b:
                look(i, a, min(b, taken[at][0]))
                a = max(a, taken[at][1])
                at += 1
            look(i, a, b)
        return found


def normalised(chunk: Chunk) -> tuple[str, np.ndarray, np.ndarray]:
    """The words of a chunk with a space after each, a line break between texts; where each word begins; each word's row.

    One character per byte, so places in the string are places in the bytes.
    """
    data = LOWER[chunk.data]
    inside = IS_WORD[data]
    start, end, row = spans(chunk, inside)
    if not len(start):
        return "\n\n", np.zeros(0, np.int64), row
    length = end - start
    begins = 1 + np.concatenate([[0], np.cumsum(length + 1)[:-1]])
    out = np.full(int(begins[-1] + length[-1] + 1), 0x20, np.uint8)
    word = np.repeat(np.arange(len(start)), length)
    out[1 + np.arange(len(word)) + word] = data[inside]
    out[begins[1:][row[1:] != row[:-1]] - 1] = 0x0A
    out[0] = out[-1] = 0x0A
    return out.tobytes().decode("latin-1"), begins, row


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """One row per input row: doc_id, n_words and spans (label, exact, first and last word, edits, similarity)."""
    data = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(phrases, notices)
        for batch in batches:
            for c in chunks(batch.column(1)):
                whole, begins, row = normalised(c)
                n_words = np.bincount(row, minlength=c.n)
                before = np.concatenate([[0], np.cumsum(n_words)])
                per_row: list[list[dict]] = [[] for _ in range(c.n)]
                for kind, i, start, end, edits in searcher.search(whole):
                    first = int(np.searchsorted(begins, max(start, 1), "right")) - 1
                    last = max(first, int(np.searchsorted(begins, end, "left")) - 1)
                    r = int(row[first])
                    last = min(last, int(before[r + 1]) - 1)
                    label, words = (phrases if kind == 0 else notices)[i]
                    per_row[r].append(
                        {
                            "label": label,
                            "exact": kind == 0,
                            "first_word": first - int(before[r]),
                            "last_word": last - int(before[r]),
                            "edits": edits,
                            "similarity": 1.0 - edits / len(words),
                        }
                    )
                kind_of = pa.list_(
                    pa.struct(
                        [("label", pa.string()), ("exact", pa.bool_()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("similarity", pa.float64())]
                    )
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.first, c.n), pa.array(n_words.astype(np.int64)), pa.array(per_row, kind_of)], ["doc_id", "n_words", "spans"]
                )

    kind = data.schema["doc_id"].dataType.simpleString()
    return data.mapInArrow(run, f"doc_id {kind}, n_words long, spans {SPAN_TYPE}")


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["exact"])
    labels = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["first_word"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["similarity"])), F.lit(0.0)).alias("score"),
    )
