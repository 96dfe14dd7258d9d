"""Slow and plain versions of the operators' results."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def statistics(text):
    t, words = text or "", space_words(text)
    lines = [x for x in t.split("\n") if space_words(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(grams)
    hit = {p for i, g in enumerate(grams) if counts[g] > 1 for p in (i, i + 1, i + 2)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def near_duplicates(rows):
    """rows (doc_id, text) to (doc_id, n_shingles, component_id), in order."""
    sets = []
    for _, text in rows:
        w = space_words((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return [(doc_id, len(sets[i]), least[find(i)] if sets[i] else doc_id) for i, (doc_id, _) in enumerate(rows)]


def repeats(texts, window=400):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    data = [(t or "").encode() for t in texts]
    counts = Counter(b[i : i + window] for b in data for i in range(len(b) - window + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if counts[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def passages(texts, window, words):
    """(number, bytes) of each text's runs covered by repeated strings of window bytes that hold more than so many words."""
    data = [(t or "").encode() for t in texts]
    counts = Counter(b[i : i + window] for b in data for i in range(len(b) - window + 1))
    out = []
    for b in data:
        hit = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if counts[b[i : i + window]] > 1:
                hit[i : i + window] = b"\1" * window
        runs = [m.span() for m in re.finditer(rb"\x01+", bytes(hit))]
        held = [e - s for s, e in runs if len(b[s:e].split()) > words]
        out.append((len(held), sum(held)))
    return out


def contamination(text, items, size=10):
    words, hit, names = alnum_words(text), set(), set()
    for item, item_text in items:
        w = alnum_words(item_text)
        if not w:
            continue
        for i in range(max(1, len(w) - size + 1)):
            g = w[i : i + size]
            for p in range(len(words) - len(g) + 1):
                if words[p : p + len(g)] == g:
                    hit.update(range(p, p + len(g)))
                    names.add("null" if item is None else str(item))
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def base_places(text, phrases):
    words, places, labels = alnum_words(text), [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))
