"""Fill-in-middle transformation by repeated-capture matching.

A text is units: runs of the letters A-Z and a-z, and single other code points.
One ``fullmatch`` of ``(unit)*`` in the regex library keeps every repetition of
its group, so ``ends(1)`` is the list of unit ends: its length is the number of
units, and the entry before a cut is the cut's offset.  The library needs about
100 bytes a code point for that, so a text of more than ``SLICE`` code points is
matched slice by slice, cut between units, and the ends are put together; the
units are those of one match.  Where to cut, and how to lay out the parts, is
drawn from the sha256 of the document's id, so a rerun gives the same outputs.

Marked texts are ``<P>prefix<S>suffix<M>middle`` (psm) or
``<S>suffix<P>prefix<M>middle`` (spm); a text that is empty, holds a marker or
is drawn to stay as it is, is ``plain``.  ``restored`` takes an output apart
again.  A marker cannot arise where a part meets a marker (a part would have to
end within the marker's first characters, and no marker begins inside another),
so the first marker found is the right one.

Scale: one Arrow pass, no shuffle; a task holds one text's units at a time.

Edge cases: a null text counts as empty and is plain; a null doc_id is drawn as
the id without digits; rows that repeat an id are cut by the same draw; a very
long text is cut whole, as any other; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichelab.llm.common import table

#: Fixed values of the contract: markers, shares of plain and spm in a hundred, seed.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
SEED = 1
#: Possessive, so that no repetition is ever given back.
UNITS = regex.compile(r"([A-Za-z]++|[^A-Za-z])*+")
LETTERS = regex.compile(r"[A-Za-z]*+")
#: Code points matched at a time (more where a run of letters goes on).
SLICE = 1 << 18

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """The first four 8-digit groups of the sha256 of ``seed:doc_id``."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def unit_ends(text: str) -> np.ndarray:
    """Where each unit of a text ends."""
    found, at = [], 0
    while at < len(text):
        stop = min(at + SLICE, len(text))
        if text[stop - 1].isascii() and text[stop - 1].isalpha():  # to the end of the run
            stop = LETTERS.match(text, stop).end()
        found.append(np.array(UNITS.fullmatch(text, at, stop).ends(1), np.int64))
        at = stop
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def transform(doc_id: int | None, text: str, seed: int = SEED) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars and output of one text."""
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= PLAIN_FROM:
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(ends[cut - 1]) if cut else 0 for cut in (first, last))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SPM_BELOW:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, n (units), form, prefix_chars, middle_chars, output (the transformed text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [transform(i.as_py(), t.as_py() or "", seed) for i, t in zip(batch.column(0), batch.column(1), strict=True)]
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            cols = [pa.array([m[k] for m in made], kind) for k, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(rows, SCHEMA)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made from, by its markers alone."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(F.col(output), F.lit(len(PREFIX) + 1))
        one = F.substring_index(body, first, 1)
        rest = F.substr(body, F.char_length(one) + (len(first) + 1))
        two = F.substring_index(rest, second, 1)
        return one, two, F.substr(rest, F.char_length(two) + (len(second) + 1))

    prefix, suffix, middle = parts(SUFFIX, MIDDLE)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(PREFIX, MIDDLE)
    spm = F.concat(prefix, middle, suffix)
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(), 256).alias("restored_sha256"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
c AS (
  SELECT doc_id, t, u, len(u)::BIGINT AS n,
         ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS c2,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (
  SELECT *, array_to_string(u[1 : least(c1, c2)], '') AS prefix, array_to_string(u[least(c1, c2) + 1 : greatest(c1, c2)], '') AS middle,
         array_to_string(u[greatest(c1, c2) + 1 :], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
              ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
