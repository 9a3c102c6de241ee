"""Brute-force versions of the operators, over lists of (doc_id, text)."""

import hashlib
import re

_word = re.compile(r"[^\x20\x09-\x0d]+").findall
UPPER = {c: c + 32 for c in range(65, 91)}


def shingles(text, lower=lambda t: t.translate(UPPER)):
    w = _word(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(docs, percent=85):
    sets = {d: shingles(t) for d, t in docs}
    by = {}
    for d, s in sets.items():
        if s:
            by.setdefault(frozenset(s), []).append(d)
    reps = {s: min(ids) for s, ids in by.items()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)

    for ids in by.values():
        for d in ids:
            join(d, min(ids))
    seen = {}
    for s, r in reps.items():
        near = {}
        for x in s:
            for other in seen.setdefault(x, []):
                near[other] = near.get(other, 0) + 1
            seen[x].append(s)
        for other, n in near.items():
            if 100 * n >= percent * (len(s) + len(other) - n):
                join(r, reps[other])
    return {d: (len(sets[d]), find(d)) for d in sets}


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def dropped(docs, least_words=5):
    """{doc_id: positions of dropped lines}; every line against every earlier distinct line of like length."""
    first, gone, by_size, out = set(), set(), {}, {}
    for d, text in sorted(docs, key=lambda x: (x[0], x[1] or "")):
        for i, line in enumerate((text or "").split("\n")):
            w = tuple(_word(line))
            if not w:
                continue
            if w not in first:
                first.add(w)
                if len(w) >= least_words:
                    if any(within_one(w, x) for n in (len(w) - 1, len(w), len(w) + 1) for x in by_size.get(n, ())):
                        gone.add(w)
                    by_size.setdefault(len(w), []).append(w)
                if w not in gone:
                    continue
            out.setdefault(d, []).append(i)
    return out


def runs(text, k):
    w = _word((text or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def leaks(docs, items, containment=0.8):
    sets = {i: (k, runs(t, k)) for i, t in items for k in (min(5, len(_word((t or "").lower()))),) if k}
    out = {}
    for d, t in docs:
        mine = {k: runs(t, k) for k in {k for k, _ in sets.values()}}
        for i, (k, s) in sets.items():
            if (n := len(s & mine[k])) >= containment * len(s):
                out[d, i] = (len(s), n)
    return out


def winnow(text, gram=8, most=64):
    """[(hash, position)]: the rightmost least hash of each window, from the definition, in whole numbers."""
    mask = (1 << 64) - 1

    def mix(x):
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> shift) * by & mask
        return x ^ x >> 31

    if not text:
        return []
    if len(text) < gram:
        return [(int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big") >> 20, 0)]
    points = [mix(ord(c) + 1) for c in text]
    grams = []
    for i in range(len(points) - gram + 1):
        h = 0
        for p in points[i : i + gram]:
            h = (h * 0x9E3779B97F4A7C15 + p) & mask
        grams.append(mix(h) >> 20)
    window = 1
    while window < most and window * 2 * 8 <= len(grams):
        window *= 2
    out, at = [], -1
    for i in range(len(grams) - window + 1):
        if at < i:
            at = max(range(i, i + window), key=lambda k: (-grams[k], k))
        elif grams[i + window - 1] <= grams[at]:
            at = i + window - 1
        if not out or out[-1][1] != at:
            out.append((grams[at], at))
    return out


def fingerprint_rows(rows):
    """For rows in order, each with the next: (n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    show = lambda f: "".join(f"{h:016x}{p:08x}" for h, p in f)

    def like(f, g):
        a, b = {h for h, _ in f}, {h for h, _ in g}
        return len(a & b) / len(a | b) if a | b else 1.0

    texts = [t or "" for t in rows]
    found = [winnow(t) for t in texts]
    for i, text in enumerate(texts):
        after = (i + 1) % len(texts)
        m = len(text) // 3
        edited = text[: len(text) - m] + texts[after][:m]
        f = winnow(edited)
        yield len(text), hashlib.sha256(edited.encode()).hexdigest(), show(found[i]), show(f), like(found[i], f), like(found[i], found[after])
