"""Fill-in-middle: contract by plain Python, round trip, odd rows."""

import hashlib
import re

import pytest
import regex
from llm_helpers import docs_frame, odd_rows, same  # noqa: F401
from pyspark.sql import functions as F

from nichelab.llm import fim


def plain(doc_id, text):
    """The contract, step by step."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = min(h[0] % (n + 1), h[1] % (n + 1)), max(h[0] % (n + 1), h[1] % (n + 1))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_odd_rows_equal_the_plain_version(spark, docs_frame, odd_rows):  # noqa: F811
    rows = [*odd_rows, (201, "has <P> in it"), (202, "<S>"), (203, "x<M"), (204, "< P><"), (205, "a<"), (206, "ab\U0001f600cd́e\r\n\x00")]
    rows += [(1000 + k, f"<<S<P M> word{k} <M <") for k in range(60)]
    docs = docs_frame(rows).withColumn("output", F.lit("clash")).withColumn("form", F.lit(1))
    made = fim.fill_in_middle(docs)
    same([tuple(r) for r in made.collect()], [plain(*r[:2]) for r in rows])
    back = made.select(F.sha2("output", 256).alias("o"), F.sha2(fim.restored(), 256).alias("r"), "doc_id").collect()
    want = [(plain(*r[:2])[5], r[1] or "", r[0]) for r in rows]
    same([(r["o"], r["r"], r["doc_id"]) for r in back], [(hashlib.sha256(o.encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), d) for o, t, d in want])
    assert {r["form"] for r in made.collect()} == {"plain", "psm", "spm"}


def test_one_match_keeps_every_unit():
    text = "one2 three--four\nfünf\x00 six"
    whole = regex.fullmatch(r"([A-Za-z]+|[^A-Za-z])*", text)
    assert list(fim.unit_ends(text)) == whole.ends(1) == [m.end() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text, re.S)]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_slices_have_the_units_of_one_match(monkeypatch, size):
    text = "ab cde  fghijklmn opqér.st " * 7 + "z" * 50
    want = list(fim.unit_ends(text))
    monkeypatch.setattr(fim, "SLICE", size)
    assert list(fim.unit_ends(text)) == want
    assert len(fim.unit_ends("")) == 0


def test_very_long_text_and_empty_table(spark, docs_frame):  # noqa: F811
    long = "word and wörd, " * 200_000
    rows = [(k, long if k == 3 else "y" * 300_000 if k == 4 else "") for k in range(3, 6)]
    same([tuple(r) for r in fim.fill_in_middle(docs_frame(rows)).collect()], [plain(*r) for r in rows])
    assert fim.fill_in_middle(docs_frame([])).count() == 0
