"""Plain versions of the operators, for comparison."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 1 << 63


def words(text):
    return WORD.findall(text or "")


def substrings(docs, window=13):
    """doc_id: (words, removed, digest) of ``[(doc_id, text)]``."""
    least, out = {}, []
    for i, t in docs:
        w = words(t)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            d = LAST if i is None else i
            if least.get(k, LAST + 1) > d:
                least[k] = d
    for i, t in docs:
        w = words(t)
        gone = set()
        for s in range(len(w) - window + 1):
            if least[tuple(w[s : s + window])] < (LAST if i is None else i):
                gone.update(range(s, s + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def classes(docs, k, percent):
    """(doc_id, set size, component) by comparing every pair that shares a shingle."""
    sets, where = {}, defaultdict(list)
    for n, (_, t) in enumerate(docs):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[n] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        for x in sets[n]:
            where[x].append(n)
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for n, s in sets.items():
        for m in {m for x in s for m in where[x] if m < n}:
            both = len(s & sets[m])
            if 100 * both >= percent * (len(s) + len(sets[m]) - both):
                root[find(n)] = find(m)
    least = {}
    for n, (i, _) in enumerate(docs):
        r = find(n)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [(i, len(sets[n]), least.get(find(n)) if sets[n] else i) for n, (i, _) in enumerate(docs)]


def line_dedup(docs, min_words):
    """(doc_id, kept text) with runs of lines that occurred before removed; documents in order of id.

    A line with a word has one at least, so longer runs are unions of runs of ``min_words`` lines.
    """
    seen = {}
    parts = {i: [x for x in t.split("\n") if words(x)] for i, t in docs if t is not None}
    order = sorted(parts)
    lengths = range(1, min_words + 1)
    for i in order:
        for n in lengths:
            for s in range(len(parts[i]) - n + 1):
                seen.setdefault(tuple(parts[i][s : s + n]), (i, s))
    out = []
    for i, t in docs:
        if t is None:
            out.append((i, None))
            continue
        lost = set()
        for n in lengths:
            for s in range(len(parts[i]) - n + 1):
                run = tuple(parts[i][s : s + n])
                if seen[run] < (i, s) and sum(len(words(x)) for x in run) >= min_words:
                    lost.update(range(s, s + n))
        kept, at = [], -1
        for x in t.split("\n"):
            at += bool(words(x))
            if not (words(x) and at in lost):
                kept.append(x)
        out.append((i, "\n".join(kept)))
    return out


def copies(docs, largest=True):
    """(doc_id, id that stays, group size, digest) of each row, and how many rows of a group stay: one."""
    groups = defaultdict(list)
    for i, t in docs:
        groups[(t or "").encode().lower()].append(i)
    out = []
    for i, t in docs:
        k = (t or "").encode().lower()
        ids = [x for x in groups[k]]
        if largest:
            keep = max((x for x in ids if x is not None), default=None)
        else:
            keep = None if None in ids else min(ids)
        out.append((i, keep, len(ids), hashlib.sha256(k).hexdigest()))
    return out


def digest(*inputs):
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def merkle(rows, fanout):
    """(group, leaf, path, subroot, root) of ``[(group, order, leaf)]``; a path has the whole runs and places in them."""

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
        return out

    def path(levels, i):
        out = []
        for nodes in levels[:-1]:
            out.append((tuple(nodes[i // fanout * fanout : (i // fanout + 1) * fanout]), i % fanout))
            i //= fanout
        return out

    groups = defaultdict(list)
    for g, o, d in rows:
        groups[g].append((o is not None, o or 0, d))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([d for *_, d in sorted(groups[g])]) for g in order}
    top = levels([trees[g][-1][0] for g in order]) if order else []
    return [(g, d, tuple(path(trees[g], i) + path(top, k)), trees[g][-1][0], top[-1][0]) for k, g in enumerate(order) for i, d in enumerate(trees[g][0])]


def infilling(doc_id, text, seed=7):
    """(n, form, prefix, middle, suffix, output) of one text."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 50:
        return n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


def url_templates(counts, branches=20, z=1.96, strength=10.0):
    """(host, shape): (template, purity) of ``{(host, shape): [good, seen]}``, node by node."""
    prior = (sum(g for g, _ in counts.values()) + 1) / (sum(n for _, n in counts.values()) + 2)
    names = {}

    def grow(rows, node, k):
        """``rows`` share a node at depth ``k``."""
        if len(rows) == 1:
            host, shape = rows[0]
            names[rows[0]] = "/".join([node, *shape[k:]])
            return
        wide = len({s[k] for _, s in rows}) > branches
        for last in (False, True):
            kids = defaultdict(list)
            for r in rows:
                if (len(r[1]) == k + 1) == last:
                    kids["*" if wide else r[1][k]].append(r)
            sums = {c: [sum(counts[r][i] for r in rs) for i in (0, 1)] for c, rs in kids.items()}
            share = lambda g, n: (g + strength * prior) / (n + strength)
            groups = []
            for c in sorted(kids, key=lambda c: (share(*sums[c]), c)):
                q, w = share(*sums[c]), sums[c][1] + strength
                if groups:
                    members, g, n = groups[-1]
                    p = share(g, n)
                    if q - p <= z * (p * (1 - p) / (n + strength) + q * (1 - q) / w) ** 0.5:
                        groups[-1] = (members + [c], g + sums[c][0], n + sums[c][1])
                        continue
                groups.append(([c], *sums[c]))
            for members, *_ in groups:
                inner = [r for c in members for r in kids[c]]
                name = node + "/" + "//".join(sorted(members))
                if last:
                    names.update(dict.fromkeys(inner, name))
                else:
                    grow(inner, name, k + 1)

    for host in {h for h, _ in counts}:
        own = [r for r in counts if r[0] == host and r[1]]
        names.update({r: "" for r in counts if r[0] == host and not r[1]})
        if own:
            grow(own, "", 0)
    pure = defaultdict(lambda: [0.0, 0.0])
    for (host, shape), name in names.items():
        for i in (0, 1):
            pure[host, name][i] += counts[host, shape][i]
    return {(h, s): (n, (pure[h, n][0] + strength * prior) / (pure[h, n][1] + strength)) for (h, s), n in names.items()}
