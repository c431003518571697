"""Plain forms of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
KINDS = (("assign", ASSIGN, 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16))
LOWER = {c: c + 32 for c in range(65, 91)}


def secrets(text):
    text = text or ""
    spans = sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(KINDS) for m in p.finditer(text) if len(m[g]) >= n)
    digest = hashlib.sha256(",".join(f"{KINDS[k][0]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
    return [sum(s[1] == k for s in spans) for k in range(3)], digest


def shingles(text):
    words = [w.translate(LOWER) for w in re.findall("[^\x20\x09-\x0d]+", text or "")]
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < 5 else (tuple(words[i : i + 5]) for i in range(len(words) - 4)))


def roots(items, links):
    parent = {i: i for i in items}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in items}


def jaccard_components(rows):
    """{doc_id: (n_shingles, component)}."""
    sets = {d: shingles(t) for d, t in rows}
    lists, common = defaultdict(list), defaultdict(int)
    for d, s in sets.items():
        for t in s:
            lists[t].append(d)
    for members in lists.values():
        for i, b in enumerate(members):
            for a in members[:i]:
                common[a, b] += 1
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    where = roots(sets, links)
    return {d: (len(s), where[d]) for d, s in sets.items()}


def vector_links(rows, threshold):
    """[(a, b)] of rows (id, vector, label)."""
    ok = [(i, np.array(v, float), lab) for i, v, lab in rows if v is not None and lab is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    return [(a, b) for x, (a, u, p) in enumerate(ok) for b, v, q in ok[:x] if p == q and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= threshold]
