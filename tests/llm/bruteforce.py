"""Plain-Python versions of the contracts, for small fixtures."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=True):
    t = text or ""
    if lower:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t)
    return WORD.findall(t)


def shingle_set(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def jaccard_components(docs, percent=75):
    """doc_id -> (set size, component) by comparing all pairs."""
    sets = {d: shingle_set(t) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    index = {}
    for d in ids:
        for s in sets[d]:
            index.setdefault(s, []).append(d)
    for x in ids:
        n = {}
        for s in sets[x]:
            for y in index[s]:
                n[y] = n.get(y, 0) + 1
        for y, c in n.items():
            if y > x and 100 * c >= percent * (len(sets[x]) + len(sets[y]) - c):
                a, b = sorted((find(x), find(y)))
                parent[b] = a
    return {d: (len(sets[d]), find(d)) for d in ids}
