"""Plain versions of the operators, for small inputs."""

import re
from collections import defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingle_set(text, n):
    words = WORDS.findall(lowered(text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def roots(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def ngram_components(rows, n, percent):
    """rows of (doc_id, text) to {doc_id: (n_shingles, component)}; every pair with a common shingle is compared."""
    sets = {d: shingle_set(t, n) for d, t in rows}
    groups = defaultdict(list)
    for d, s in sorted(sets.items()):
        groups[frozenset(s)].append(d)
    held, links = defaultdict(list), []
    for s, ds in groups.items():
        if s:
            links += [(ds[0], d) for d in ds[1:]]
            for x in s:
                held[x].append((ds[0], s))
    seen = set()
    for members in held.values():
        for i, (a, s) in enumerate(members):
            for b, t in members[:i]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    if 100 * len(s & t) >= percent * len(s | t):
                        links.append((a, b))
    up = roots(sets, links)
    return {d: (len(sets[d]), up[d]) for d in sets}
