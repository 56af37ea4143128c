"""Repair of conversations computed plainly, one conversation at a time, by dynamic programming over costs and audits."""

from __future__ import annotations

import hashlib
import re
import zlib

FOLLOW = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
NAMES = {"u": "user", "a": "assistant"}


def damaged(rows):
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        draw = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        yield from [(conv, turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)


def faults(rows):
    seen, found = set(), []
    for _, _, role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        found.append("blank" if not words else "duplicate" if (role, text) in seen
                     else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def cheapest(rows, found):
    """(cost, audit, repaired rows) of the least audit among the cheapest."""
    after = {"": (0, "", ()), "a": (0, "", ())}
    for i in range(len(rows), -1, -1):
        now = dict(after) if i == len(rows) else {}
        for _ in range(4):
            for state, follow in FOLLOW.items():
                ways = [now[state]] if state in now else []

                def way(letter, cost, beyond, line=()):
                    if beyond:
                        ways.append((cost + beyond[0], letter + beyond[1], line + beyond[2]))

                if i < len(rows):
                    role, text = rows[i][2:]
                    extra = 5 if found[i] == "truncated" else 0
                    way("D", 2, after.get(state))
                    if found[i] not in ("blank", "duplicate"):
                        if role[:1] in follow:
                            way("K", extra, after.get(follow[role[:1]]), (f"{role}:{text}",))
                        for to in follow.values():
                            if to in NAMES:
                                way("R", 1 + extra, after.get(to), (f"{NAMES[to]}:{text}",))
                for to in follow.values():
                    if to in NAMES:
                        way("I", 5, now.get(to), (f"{NAMES[to]}:",))
                if ways:
                    now[state] = min(ways)
        after = now
    return after[""]


def repaired(table):
    """The rows of the digest of ``(conv_id, turn, role, text)``."""
    out = []
    for conv in {row[0] for row in table}:
        rows = sorted(damaged([r for r in table if r[0] == conv]), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        found = faults(rows)
        turns = {r[1] for r in rows if r[1] is not None}
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
        cost, audit, lines = cheapest(rows, found)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0,
                    *[found.count(name) for name in ("blank", "duplicate", "truncated")],
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out
