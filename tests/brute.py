"""Plain Python readings of the semantics, to check the distributed operators against."""

from __future__ import annotations


def jaro_winkler(s: str, t: str) -> float:
    if s == t:
        return 1.0
    window = max(len(s), len(t)) // 2 - 1
    partner = {}
    for i, c in enumerate(s):
        for j, d in enumerate(t):
            if c == d and abs(i - j) <= window and j not in partner.values():
                partner[i] = j
                break
    if not partner:
        return 0.0
    m = len(partner)
    left = [s[i] for i in sorted(partner)]
    right = [t[j] for j in sorted(partner.values())]
    half = sum(x != y for x, y in zip(left, right)) // 2
    jaro = (m / len(s) + m / len(t) + (m - half) / m) / 3
    prefix = 0
    while prefix < min(4, len(s), len(t)) and s[prefix] == t[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def edits(s: str, t: str) -> int:
    previous = list(range(len(t) + 1))
    for i, c in enumerate(s, 1):
        row = [i]
        for j, d in enumerate(t, 1):
            row.append(min(previous[j] + 1, row[-1] + 1, previous[j - 1] + (c != d)))
        previous = row
    return previous[-1]


def walk_order(pairs):
    """Best score first, unscored last, then ids."""
    return sorted(pairs, key=lambda p: (p["score"] is None, -(p["score"] or 0), p["a"], p["b"]))


def grouped(pairs):
    """``{(task, id, label, score)}`` of the greedy group walk with singletons."""
    out = set()
    for task in {p["task"] for p in pairs}:
        own = [p for p in pairs if p["task"] == task]
        members = {}
        for p in own:
            members.setdefault(p["label"], set()).update((p["a"], p["b"]))
        used = set()
        for p in walk_order(own):
            if p["a"] not in used and p["b"] not in used:
                out |= {(task, i, p["label"], p["score"]) for i in members[p["label"]]}
                used |= members[p["label"]]
        everyone = set().union(*members.values())
        out |= {(task, i, "Singleton", 0.0) for i in everyone - used}
    return out


def couples(pairs):
    out = set()
    for task in {p["task"] for p in pairs}:
        used = set()
        for p in walk_order([p for p in pairs if p["task"] == task]):
            if p["a"] not in used and p["b"] not in used:
                used |= {p["a"], p["b"]}
                out.add((task, p["a"], p["b"], p["label"], p["score"]))
    return out


def numbers(pairs):
    """``{(task, label): number}`` by first appearance."""
    out = {}
    for p in sorted(pairs, key=lambda p: (p["task"], p["a"], p["b"])):
        out.setdefault((p["task"], p["label"]), len(out) + 1)
    return out
