"""License, secret and URL scans: base results against plain Python versions, the methods' own finds, odd tables."""

import random
import string

import brute
import pytest
from llm_helpers import docs_frame, odd_rows, same  # noqa: F401
from pyspark.sql import functions as F

from nichelab.llm import license, secrets, urls

NAMES = secrets.KINDS


def test_license_base(spark, docs_frame, odd_rows):
    rows = [*odd_rows, (200, "The MIT  License, mit-license; Apache\nLicense"), (201, "general public license general public license"), (202, "xmit license mit licenses")]
    out = license.scan(docs_frame(rows)).collect()
    got = []
    for r in out:
        base = [s for s in r["spans"] if s["exact"]]
        starts = [s["first_word"] for s in base]
        got.append((r["doc_id"], r["n_words"], len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({s["label"] for s in base}))))
    same(got, brute.license_base(rows))
    assert license.scan(docs_frame([])).count() == 0


@pytest.mark.parametrize("notice", [n for _, n in license.NOTICES])
def test_pieces_cover_a_notice(notice):
    edits = license.allowed_edits(notice)
    parts = license.pieces(notice, edits)
    assert "".join(p for _, p in parts) == notice and len(parts) == edits + 1
    assert all(notice[at : at + len(p)] == p for at, p in parts)


def test_license_fuzzy(docs_frame):
    """Any place within the allowed edits is found, at its words and with its edits; clean text has none."""
    rng = random.Random(3)
    label, notice = "mpl", "mozilla public license version 2 0"
    rows, want = [], {}
    for i in range(40):
        text, edits = notice, rng.randrange(0, license.allowed_edits(notice) + 1)
        for at in rng.sample(range(2, len(notice) - 2), edits):
            text = text[:at] + "q" + text[at + 1 :]
        rows.append((i, "some words before it " + text + " and words after it"))
        want[i] = edits
    rows.append((99, "clean text about a public place and a version of events"))
    for r in license.scan(docs_frame(rows)).collect():
        found = [s for s in r["spans"] if s["label"] == label]
        if r["doc_id"] == 99:
            assert not r["spans"]
        else:
            assert len(found) == 1 and found[0]["edits"] <= want[r["doc_id"]] and found[0]["first_word"] == 4


@pytest.mark.parametrize(
    "texts",
    [
        ["some text licensd under cc by 4 0", "licensed under cc by 4 0 other text"],
        ["licensd under cc by 4 0"] * 5 + ["licensed under cc by 4 0"],
        ["licensd under cc by 4 0 licensed undr cc by 4 0 licensed under cc by 4 0 licensed uder c by 4 0"],
        ["licensed undr cc by 4 0 released under the mit licence licensed under cc by 4 0", "relased under the mit license"],
    ],
)
def test_license_neighbours(docs_frame, texts):
    """Notices with different edits, back to back and in adjacent rows, are all found."""
    rows = list(enumerate(texts))
    out = {r["doc_id"]: [s for s in r["spans"] if not s["exact"]] for r in license.scan(docs_frame(rows).coalesce(1)).collect()}
    for i, text in rows:
        n = text.count(" 4 0") + text.count(" mit ")
        assert len(out[i]) == n and sum(s["edits"] == 0 for s in out[i]) == sum(text.count(x) for _, x in license.NOTICES)


def secret_rows(odd_rows):
    hexes = "0123456789abcdef" * 2
    return [
        *odd_rows,
        (300, f'token = "{hexes}" and PassWord: abc, passwd=abcdef api-key=zzzzzzz apikey: "qwerty12"'),
        (301, f"é日 AKIA{'A1B2C3D4E5F6G7H8'} secret=token=abcdef {hexes}\x00{hexes}"),
        (302, "token token=  secret : x y token='a.b.c=d/e+f'"),
        (303, hexes + "g" + hexes + " AKIAshort AKIA" + "Z" * 15 + " AKIA" + "Z" * 16),
    ]


def test_secret_base(docs_frame, odd_rows):
    rows = secret_rows(odd_rows)
    got = [(r["doc_id"], str([(s["start"], s["kind"], s["end"]) for s in r["spans"] if s["kind"] < 3])) for r in secrets.scan(docs_frame(rows)).collect()]
    same(got, [(d, str(s)) for d, s in brute.secret_base(rows)])
    assert secrets.scan(docs_frame([])).count() == 0


def test_markov_models(docs_frame):
    """Random strings in no pattern are found at their places, long ordinary identifiers are not."""
    rng = random.Random(9)
    common = ["configuration", "management", "interface", "document", "service", "handler", "request", "process"]
    plain = ["".join(rng.choice(common).title() for _ in range(3)) + rng.choice(["", "2", "_v1"]) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(plain) + " " + rng.choice(common) for _ in range(60))) for i in range(60)]
    rows += [(100 + i, "token = " + "".join(rng.choice(string.hexdigits.lower()) for _ in range(40))) for i in range(20)]
    planted = {}
    for i in range(30):
        s = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(32))
        if any(c.isdigit() for c in s):
            text = "see the " + s + " for the service " + rng.choice(plain)
            rows.append((200 + i, text))
            planted[200 + i] = (8, 40)
    found = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == 3] for r in secrets.scan(docs_frame(rows)).collect()}
    hits = sum(planted[d] in found[d] for d in planted)
    assert hits >= 0.9 * len(planted)
    assert sum(len(v) for d, v in found.items() if d < 100) == 0


def test_markov_letters_only(docs_frame):
    """Random strings without a digit are scored too; long ordinary words, rules and numbers stay out."""
    rng = random.Random(10)
    common = ["configuration", "management", "interface", "document", "service", "handler", "request", "process"]
    plain = ["".join(rng.choice(common).title() for _ in range(3)) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(plain) + " " + rng.choice(common) for _ in range(60))) for i in range(60)]
    rows += [(100 + i, "token = " + "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40))) for i in range(60)]
    rows += [(200 + i, "see the " + "".join(rng.choice(string.ascii_letters) for _ in range(32)) + " for the service " + rng.choice(plain)) for i in range(30)]
    rows += [(300 + i, "=" * (40 + i) + " " + "-" * 60 + " " + "_" * 20) for i in range(3)]
    found = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == 3] for r in secrets.scan(docs_frame(rows)).collect()}
    assert sum((8, 40) in found[d] for d in range(200, 230)) >= 27
    assert sum(len(v) for d, v in found.items() if d < 100 or d >= 300) == 0


PAGES = "page_id long, url string, host string, verdict string"


def rule_of(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = host.translate(brute.LOWER)
    best = None
    for verdict, rule in urls.RULES:
        name, _, prefix = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + prefix) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def test_url_rules(spark):
    rng = random.Random(1)
    shapes = ["http://{h}.Example.org/{l}/{n}?x=/es/", "https://{h}.example.com/{l}/{n}#top", "ftp://{h}.net/{l}", "http://a.b.example.org/en/{n}.html"]
    found = [rng.choice(shapes).format(h=rng.choice("abcd"), l=rng.choice(["es", "fr", "de", "en"]), n=rng.randrange(300)) for _ in range(400)]
    found += [None, "", "no scheme", "://", "http://", "http://org", "http://org/", "x://y://z/p", "http://notexample.org/es/", "http://EXAMPLE.ORG?/es/", "http://é.com/fr/ü"]
    rows = [(i, u, "clash", "clash") for i, u in enumerate(found)] + [(None, found[0], None, None), (0, found[0], None, None)]
    out = urls.judge(spark.createDataFrame(rows, PAGES)).collect()
    assert len(out) == len(rows)
    by = {r["page_id"]: r for r in out}
    for i, u in enumerate(found):
        host, path, best = rule_of(u)
        assert (by[i]["host"], by[i]["path"], by[i]["rule"]) == (host, path, best and best[1])
        assert by[i]["verdict"] == best[0] if best else by[i]["verdict"] in ("allow", "block")


def test_url_method(spark):
    """The trees carry what the labelled URLs show over to hosts without a rule."""
    rng = random.Random(2)
    good = [f"http://site{rng.randrange(50)}.{t}/articles/{rng.choice(['news', 'arts'])}" for t in ("org", "net") for _ in range(300)]
    bad = [f"http://x{rng.randrange(10**9)}-{rng.randrange(10**9)}.{t}/?a={rng.randrange(99)}&b={rng.randrange(99)}&c=1" for t in ("com", "net") for _ in range(300)]
    rules = (("allow", "org/"), ("block", "com/"))
    rows = [(i, u) for i, u in enumerate(good + bad)]
    out = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    free = [i for i, u in rows if ".net" in u]
    right = sum((out[i]["verdict"] == "block") == (i >= len(good)) for i in free)
    assert right >= 0.95 * len(free)


def test_url_statistics_leave_the_row_out(spark):
    """With its own label left out, a suffix that one labelled URL has alone says nothing about it."""
    rows = spark.createDataFrame([("a", "a.org", "", 0.0), ("b", "b.com", "", 1.0), ("a", "c.org", "", 1.0)], "top string, domain string, file string, blocked double")
    stats, overall = urls.suffix_statistics(rows), 2 / 3
    fit = {r["domain"]: r for r in urls.with_rates(rows, stats, overall, F.col("blocked")).collect()}
    assert all(abs(r["domain_rate"] - overall) < 1e-12 for r in fit.values())
    assert abs(fit["a.org"]["top_rate"] - (1 + urls.PRIOR * overall) / (1 + urls.PRIOR)) < 1e-12
    new = spark.createDataFrame([("a", "c.org", "new")], "top string, domain string, file string")
    got = urls.with_rates(new, stats, overall).first()
    want = [(1 + urls.PRIOR * overall) / (2 + urls.PRIOR), (1 + urls.PRIOR * overall) / (1 + urls.PRIOR), overall]
    assert [got["top_rate"], got["domain_rate"], got["file_rate"]] == pytest.approx(want)


def test_url_without_labels(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(empty).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://b.org/")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(one).collect()} == {1: "allow", 2: "allow"}
