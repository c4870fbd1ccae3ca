"""Plain versions of the operators' rules, for small tables."""

import hashlib
import re
from collections import defaultdict

import numpy as np

SPACE = " \t\n\v\f\r"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def low(text):
    return text.encode().lower().decode()


def lines(docs, min_chars=40, min_docs=5):
    key = lambda x: low(x.strip(SPACE))
    holders = defaultdict(set)
    for d, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders[key(x)].add(d)
    out = []
    for d, t in docs:
        all_ = (t or "").split("\n")
        keep = [x for x in all_ if len(holders.get(key(x), ())) < min_docs or d == max(holders[key(x)])]
        out.append((d, len(all_), len(all_) - len(keep), sha("\n".join(keep))))
    return out


ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs, items, window=13):
    grams = defaultdict(set)
    for i, t in items:
        w = ITEM_WORD.findall(low(t or ""))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            grams[tuple(w[k:k + window])].add(str(i))
    sizes = {len(g) for g in grams}
    out = []
    for d, t in docs:
        w = ITEM_WORD.findall(low(t or ""))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k:k + n])) in grams:
                    hit |= set(range(k, k + n))
                    found |= grams[g]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def roots(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingle_set(text, k=5):
    w = WORD.findall(low(text or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near(docs):
    sets = {d: shingle_set(t) for d, t in docs}
    where = defaultdict(set)
    for d, s in sets.items():
        for g in s:
            where[g].add(d)
    links, seen = [], set()
    for d, s in sets.items():
        shared = defaultdict(int)
        for g in s:
            for e in where[g]:
                if e < d:
                    shared[e] += 1
        for e, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[e]) - n):
                links.append((d, e))
    del seen
    comp = roots(sets, links)
    return [(d, len(sets[d]), comp[d], comp[d] == d) for d, _ in docs]


def repeated_words(docs, window=20):
    first = {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        w = WORD.findall(t or "")
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i:i + window]), (d, i))
    out = []
    for d, t in docs:
        w = WORD.findall(t or "")
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < (d, i):
                gone[i:i + window] = True
        out.append((d, len(w), int(gone.sum()), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def repeated_bytes(docs, window=50):
    first = {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        b = (t or "").encode()
        for i in range(len(b) - window + 1):
            first.setdefault(b[i:i + window], d)
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - window + 1):
            if first[b[i:i + window]] < d:
                gone[i:i + window] = True
        runs = int((gone[:-1] & ~np.r_[False, gone[:-1]][:len(b)]).sum()) if len(b) else 0
        out.append((d, len(b), int(gone.sum()), runs, sha(bytes(x for x, g in zip(b, gone, strict=False) if not g))))
    return out
