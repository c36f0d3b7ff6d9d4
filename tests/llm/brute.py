"""Plain, slow versions of the operators for small tables."""

import collections
import hashlib
import re

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def phrases(docs, items, size=10):
    """[(id, n_words, n_hit, items)] for docs [(id, text)] and items [(id, text)]."""
    windows = collections.defaultdict(set)
    for item, text in items:
        w = alnum(text)
        for i in range(max(1, len(w) - size + 1)):
            if w:
                windows[tuple(w[i : i + size])].add(item)
    out = []
    for doc, text in docs:
        w, hit, found = alnum(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                own = windows.get(tuple(w[i : i + n]))
                if own:
                    found |= own
                    hit |= set(range(i, i + n))
        out.append((doc, len(w), len(hit), found))
    return out


def near_phrases(docs, items, size, slop):
    """{id: (items with an exact window, items with one in proximity only)}."""
    out = {}
    for doc, text in docs:
        w, exact, close = alnum(text), set(), set()
        for item, own in items:
            own = alnum(own)
            for k in range(max(1, len(own) - size + 1)):
                t = own[k : k + size]
                for s in range(-slop, len(w) + slop):
                    if w[max(s, 0) : s + len(t)] == t and s >= 0:
                        exact.add(item)
                    if all(x in w[max(0, s + j - slop) : max(0, s + j + slop + 1)] for j, x in enumerate(t)):
                        close.add(item)
        out[doc] = (exact, close - exact)
    return out


def near(docs, size=4, percent=80):
    """[(id, n_shingles, component)] for docs [(id, text)]; ids may repeat or be None."""
    sets = []
    for _, text in docs:
        w = spaced(text)
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            k = len(a & b)
            if a and b and 100 * k >= percent * (len(a) + len(b) - k):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return [
        (doc, len(sets[i]), least.get(root(i)) if sets[i] else doc) for i, (doc, _) in enumerate(docs)
    ]


def repeats(texts, length, least_words=0):
    """[(n_bytes, n_removed, n_spans, kept)] for texts; runs of fewer words stay."""
    data = [(t or "").encode() for t in texts]
    count = collections.Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        for run in re.finditer(rb"\x01+", bytes(gone)):
            lo, hi = run.span()
            words = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)]
            if sum(lo <= s and e <= hi for s, e in words) < least_words:
                gone[lo:hi] = bytes(hi - lo)
        runs = len([x for x in bytes(gone).split(b"\0") if x])
        out.append((len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
