"""Plain versions of the operators for small tables."""

import hashlib


def shingles(text, n=5):
    w = (text or "").lower().split()
    if not w:
        return set()
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))}


def reach(ids, links):
    """Smallest id reachable from every id; None only where all are None."""
    up = {i: i for i in range(len(ids))}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[root(a)] = root(b)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(root(i), []).append(ids[i])
    low = {r: min((x for x in g if x is not None), default=None) for r, g in groups.items()}
    return [low[root(i)] for i in range(len(ids))]


def jaccard(rows, threshold=0.8):
    """(doc_id, n_links, component_id) per row of (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i)
             if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])]
    n = [0] * len(rows)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return list(zip([r[0] for r in rows], n, reach([r[0] for r in rows], links)))


def repeats(rows, length=50):
    """(doc_id, n_bytes, n_removed, n_spans, sha256 of the rest) per row."""
    top = 1 << 63
    docs = [(top if i is None else i, i, (t or "").encode()) for i, t in rows]
    first = {}
    for k, _, b in docs:
        for p in range(len(b) - length + 1):
            g = b[p:p + length]
            first[g] = min(first.get(g, top), k)
    out = []
    for k, i, b in docs:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < k:
                gone[p:p + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for x in range(len(gone)) if gone[x] and (x == 0 or not gone[x - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def edit_in(pattern, text):
    """Smallest edit distance of the pattern to any substring."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        prev, row[0] = row[:], i
        for j, c in enumerate(text, 1):
            row[j] = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (p != c))
    return min(row)
