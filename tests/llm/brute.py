"""Plain counterparts of the corpus operators for small tables."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingle_set(text, k=5):
    w = WORD.findall(fold(text))
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def smallest_reachable(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_duplicates(rows, percent=85):
    """(id, n_shingles, component_id, kept) of (id, text) rows."""
    sets = [shingle_set(t) for _, t in rows]
    have = {}
    for i, s in enumerate(sets):
        for x in s:
            have.setdefault(x, []).append(i)
    pairs = {(a, b) for v in have.values() for a in v for b in v if a < b}
    links = [(a, b) for a, b in pairs
             if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and None not in (rows[a][0], rows[b][0])]
    group = smallest_reachable(range(len(rows)), links)  # rows are the nodes: an id may repeat with other text
    least = {}
    for i, (d, _) in enumerate(rows):
        least[group[i]] = d if d is None else min(d, least.get(group[i], d))
    return sorted(((d, len(s), least[group[i]], d == least[group[i]]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)
