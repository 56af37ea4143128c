"""The operators' results computed plainly, one text at a time."""

from __future__ import annotations

import hashlib
import re
import zlib

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def benchmark_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def line_rules(text):
    found, text = words(text), text or ""
    windows = [tuple(found[i:i + 3]) for i in range(len(found) - 2)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else None
    hit = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    lines = [line for line in text.split("\n") if words(line)]
    failed = len(found) < 50 or 100 * len(hit) > 50 * len(found)
    return (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(hit), failed)


def decontaminated(text, items):
    mine, hit, ids = benchmark_words(text), set(), set()
    for item, item_text in items:
        theirs = benchmark_words(item_text)
        size = min(10, len(theirs))
        windows = {tuple(theirs[i:i + size]) for i in range(len(theirs) - size + 1)} if theirs else set()
        for i in range(len(mine) - size + 1):
            if windows and tuple(mine[i:i + size]) in windows:
                hit |= set(range(i, i + size))
                ids.add("" if item is None else str(item))
    return (len(mine), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))


def fingerprint(text):
    found = words((text or "").translate(LOWER))
    if not found:
        return 0
    shingles = [" ".join(found[i:i + 3]) for i in range(len(found) - 2)] or [" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def components(fingerprints, distance=2):
    """The smallest place reachable from each."""
    parent = list(range(len(fingerprints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(fingerprints):
        for j in range(i):
            if (a ^ fingerprints[j]).bit_count() <= distance:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(fingerprints))]


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def personal(text):
    """The base spans, (start, kind, end)."""
    text, found = text or "", []
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    for place, (kind, (pattern, good)) in enumerate(kinds.items()):
        for m in re.finditer(pattern, text):
            if good(m.group()):
                found.append((m.start(), place, kind, m.end()))
    found.sort()
    listed = ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in found)
    return [sum(f[2] == kind for f in found) for kind in kinds], hashlib.sha256(listed.encode()).hexdigest(), listed


def crc32(text):
    return zlib.crc32((text or "").encode())


def passages(rows, window=20):
    """The rows of the digest of ``(doc_id, text)``; ids are unlike."""
    texts = [words(text) for _, text in rows]
    first = {}
    for r in sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0)):
        for i in range(len(texts[r]) - window + 1):
            first.setdefault(tuple(texts[r][i:i + window]), (r, i))
    found = []
    for r, (doc_id, _) in enumerate(rows):
        gone = {i + k for i in range(len(texts[r]) - window + 1) if first[tuple(texts[r][i:i + window])] != (r, i)
                for k in range(window)}
        kept = " ".join(word for i, word in enumerate(texts[r]) if i not in gone)
        found.append((doc_id, len(texts[r]), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return found
