"""Plain versions of the rules that the operators follow."""

import re
import zlib

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def classes(docs, threshold=0.8):
    """doc_id to the smallest doc_id that links lead to."""
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and len(x & y) / len(x | y) >= threshold:
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def contamination(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        if w and item is not None:
            for i in range(max(1, len(w) - size + 1)):
                windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), sorted(map(str, found))))
    return out


def repeats(docs, least=50):
    """doc_id to its words that lie in a run of `least` words that a smaller doc_id has."""
    first, hit = {}, {}
    for doc, text in sorted(docs):
        w = words(text)
        for i in range(len(w) - least + 1):
            if first.setdefault(tuple(w[i : i + least]), doc) != doc:
                hit.setdefault(doc, set()).update(range(i, i + least))
    return hit


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))
