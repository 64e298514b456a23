"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
WORD10 = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
WORD1 = re.compile("[^\x20\x09-\x0d]+")


class Union:
    def __init__(self):
        self.of = {}

    def find(self, x):
        while self.of.setdefault(x, x) != x:
            x = self.of[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.of[max(a, b)] = min(a, b)


def shingle_set(text):
    words = WORD1.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(rows):
    """doc_id -> (set size, smallest doc_id reachable)."""
    sets = {d: shingle_set(t) for d, t in rows}
    at, union = defaultdict(list), Union()
    for d, s in sets.items():
        for g in s:
            at[g].append(d)
    pairs = {(min(a, b), max(a, b)) for ds in at.values() for a in ds for b in ds if a != b}
    for a, b in pairs:
        shared = len(sets[a] & sets[b])
        if 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
            union.join(a, b)
    return {d: (len(s), union.find(d)) for d, s in sets.items()}


def repeated_bytes(rows, length=200):
    """A list of (doc_id, n_bytes, n_removed, n_spans, sha256)."""
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, z in zip(b, gone, strict=True) if not z)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def contamination(rows, items):
    windows = defaultdict(set)
    for item, text in items:
        words = WORD10.findall((text or "").translate(LOWER))
        for i in range(max(1, len(words) - 9) if words else 0):
            windows[tuple(words[i : i + 10])].add(item)
    out = {}
    for d, text in rows:
        words = WORD10.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if (w := tuple(words[i : i + n])) in windows:
                    found |= windows[w]
                    hit.update(range(i, i + n))
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out[d] = (len(words), len(hit), len(found), digest, bool(hit))
    return out


def kept_lines(rows, shingles, similarity):
    """doc_id -> text left; rows with equal id and text count once."""
    lines, union = {}, Union()
    rows = sorted(set((d, t or "") for d, t in rows))
    for _, t in rows:
        for line in t.split("\n"):
            if line.strip():
                lines.setdefault(line.strip(), len(lines))
    sets = [shingles(x) for x in lines]
    for a in range(len(sets)):
        union.find(a)
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared >= similarity * (len(sets[a]) + len(sets[b]) - shared):
                union.join(a, b)
    seen, out = set(), {}
    for d, t in rows:
        left = []
        for line in t.split("\n"):
            if line.strip():
                c = union.find(lines[line.strip()])
                if c in seen:
                    continue
                seen.add(c)
            left.append(line)
        out[d] = "\n".join(left)
    return out
