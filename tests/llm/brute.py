"""Brute-force versions to hold the operators against."""

import hashlib
from collections import defaultdict


def suffix_dedup(docs, length=200):
    places = defaultdict(int)
    data = [(i, (t or "").encode()) for i, t in docs]
    for _, b in data:
        for s in range(len(b) - length + 1):
            places[b[s : s + length]] += 1
    out = {}
    for i, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if places[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def substring_dedup(docs, length=20):
    first, data = {}, sorted((i, (t or "").encode().split()) for i, t in docs)
    out = {}
    for i, w in data:
        gone = bytearray(len(w))
        for s in range(len(w) - length + 1):
            key = tuple(w[s : s + length])
            if first.setdefault(key, (i, s)) != (i, s):
                gone[s : s + length] = b"\1" * length
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def components(edges):
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def near_duplicates(docs):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = sorted(sets)
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    label = components(edges)
    return {i: (len(sets[i]), label.get(i, i), label.get(i, i) == i) for i in ids}


def base_pii(text):
    """Patterns written out once more, one character at a time where they differ from the library's."""
    import re

    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if max(map(int, m[0].split("."))) <= 255:
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out
