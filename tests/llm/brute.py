"""Plain-Python versions of what the operators on shingles must give."""

import re

LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(rows):
    """[(doc_id, n_shingles, component_id)] for rows of (doc_id, text), by comparing all pairs."""
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [(d, len(s), least.get(top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def contaminations(docs, items, threshold=80):
    """{(doc_id, item_id, n_shingles, n_shared)} for distinct rows of (id, text)."""
    out = []
    sets = [(d, shingles(t)) for d, t in sorted(set(docs), key=str)]
    for i, t in sorted(set(items), key=str):
        s = shingles(t)
        out += [(d, i, len(s), len(s & x)) for d, x in sets if s and 100 * len(s & x) >= threshold * len(s)]
    return sorted(out, key=str)
