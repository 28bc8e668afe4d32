"""Plain Python versions of the corpus operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TOKEN = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return (text or "").translate(LOWER)


def words(text):
    return WORD.findall(lower(text))


def tokens(text):
    return TOKEN.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def decontaminate(docs, items, span=10):
    """(doc_id, n_words, n_hit, sorted items) per document."""
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        m = min(len(w), span)
        for i in range(len(w) - m + 1 if w else 0):
            windows[tuple(w[i : i + m])].add(item)
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                of = windows.get(tuple(w[i : i + m]))
                if of is not None:
                    hit.update(range(i, i + m))
                    found |= of
        out.append((doc, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


def substring(docs, span=13):
    """(doc_id, n_words, n_removed, digest of the kept words) per document."""
    first = {}
    for doc, text in docs:
        w = tokens(text)
        for i in range(len(w) - span + 1):
            g = tuple(w[i : i + span])
            if doc is not None:
                first[g] = min(first.get(g, doc), doc)
    out = []
    for doc, text in docs:
        w = tokens(text)
        gone = set()
        for i in range(len(w) - span + 1):
            if doc is not None and first[tuple(w[i : i + span])] < doc:
                gone.update(range(i, i + span))
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def exact(docs):
    """(doc_id, keep_id, group_size, kept, digest) per document; null ids are smallest."""
    groups = defaultdict(list)
    for doc, text in docs:
        groups[lower(text)].append(doc)
    keep = {k: max((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return [(d, keep[lower(t)], len(groups[lower(t)]), d == keep[lower(t)], sha(lower(t))) for d, t in docs]


def shingles(text, width=5):
    w = TOKEN.findall(lower(text))
    if 0 < len(w) < width:
        return {tuple(w)}
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def jaccard(docs):
    """(doc_id, n_shingles, component_id) per document; rows that share a doc_id are linked."""
    sets = [shingles(t) for _, t in docs]
    parent = {d: d for d, _ in docs if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for i, (doc, _) in enumerate(docs):
        if doc is None:
            continue
        both = Counter(j for g in sets[i] for j in index[g])
        for j, n in both.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(doc), root(docs[j][0])))
                parent[b] = a
        for g in sets[i]:
            index[g].append(i)
    return [(d, len(s), None if d is None else root(d)) for (d, _), s in zip(docs, sets, strict=True)]


PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))


def license_base(docs):
    out = []
    for doc, text in docs:
        w = words(text)
        at = [(i, label) for label, p in PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in at]
        out.append((doc, len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))))
    return out


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secret_base(docs):
    """(doc_id, spans) with spans (start, kind, end) in order."""
    out = []
    for doc, text in docs:
        text = text or ""
        spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
        out.append((doc, sorted(spans)))
    return out


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Target per source, of {source: words}."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, full = share * sum(sizes.values()), set()
    while True:
        left = budget - sum(most * sizes[s] for s in full)
        total = sum(weight[s] for s in order if s not in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / total for s in order}
        over = {s for s in order if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over
