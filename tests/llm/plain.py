"""Brute-force forms that the operators are held against."""

import re

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def components(rows, num=80, den=100):
    """doc_id -> smallest id reachable over links, for (doc_id, text) with distinct ids."""
    sets = {k: shingles(t) for k, t in rows}
    ids = sorted(sets)
    parent = {k: k for k in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {k: find(k) for k in ids}, {k: len(s) for k, s in sets.items()}


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def personal(text):
    out = []
    for i, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            found, digits = m.group(), re.sub("[^0-9]", "", m.group())
            luhn = sum(d if j % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for j, d in enumerate(map(int, digits[::-1]))) % 10 == 0
            if kind == "ip" and any(int(x) > 255 for x in found.split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), i, m.end()))
    return sorted(out)


def masked(text):
    parts, at = [], 0
    for start, kind, end in personal(text):
        if start >= at:
            parts += [text[at:start], f"[{list(PATTERNS)[kind].upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])
