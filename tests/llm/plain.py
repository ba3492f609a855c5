"""Plain versions of what the operators compute, for small inputs."""

import hashlib
import re
from collections import defaultdict

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def components(ids, edges):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def near_copies(rows, threshold=85):
    """{id: (set size, component)}"""
    sets = defaultdict(set)
    for i, text in rows:
        w = words((text or "").translate(ASCII_LOWER))
        sets[i] |= {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    ids = sorted(sets)
    edges = [
        (a, b)
        for k, a in enumerate(ids)
        for b in ids[:k]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])
    ]
    name = components(ids, edges)
    return {i: (len(sets[i]), name[i]) for i in ids}


def without_repeats(rows, window=13):
    """Rows of (id, words, removed, kept text)."""
    first = {}
    for i, text in rows:
        w = words(text)
        for k in range(len(w) - window + 1):
            run = tuple(w[k : k + window])
            first[run] = min(first.get(run, i), i)
    out = []
    for i, text in rows:
        w = words(text)
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), " ".join(kept)))
    return out


def contamination(rows, items, window=13):
    """Rows of (id, words, hit words, items, contaminated)."""
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(ASCII_LOWER))
    out = []
    for i, text in rows:
        w, hit, own = split(text), set(), set()
        for item, other in items:
            v = split(other)
            n = min(window, len(v))
            for k in range(len(v) - n + 1) if v else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[k : k + n]:
                        hit.update(range(p, p + n))
                        own.add(str(item))
        out.append((i, len(w), len(hit), sorted(own), bool(hit) and 20 * len(hit) >= len(w)))
    return out


ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def known_secrets(text):
    """Sorted (start, kind, end) of the base forms."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def masked(text, spans, mask="[secret]"):
    """Text with the (start, kind, end) spans replaced, overlapping ones as one."""
    out, at = [], 0
    for start, _, end in spans:
        if start > at or not out:
            out.append(text[at:start])
        at = max(at, end)
    return mask.join([*out, text[at:]]) if spans else text


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()
