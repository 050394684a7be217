"""Plain versions of the operators, one row at a time, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def rule_counts(text):
    text = text or ""
    ws = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    count = Counter(grams)
    inside = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(5)}
    n, rep = len(ws), len(inside)
    return (n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, rep, n < 10 or 100 * rep > 20 * n)


def shingles(text, k):
    ws = words((text or "").translate(UPPER))
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1)))


def near_duplicates(rows, k=4, percent=80):
    """doc_id -> (n_shingles, component, kept) for rows (doc_id, text) with distinct ids."""
    sets = {i: shingles(t, k) for i, t in rows}
    by = defaultdict(list)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in by[s])
        for j, c in common.items():
            if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for s in sets[i]:
            by[s].append(i)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def chat_digest(turns):
    """turns: (role, text) in order."""
    whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha(whole), len(loss), sha(loss)


def leaks(rows, items, k=5, similar=0.8):
    """(doc_id, item_id) -> best similarity over all windows of the item's size, by weighted shingles."""
    out = {}
    grams = lambda ws: [tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))] if ws else []
    told = [(i, words((t or "").translate(UPPER))) for i, t in items]
    shingled = [(i, len(ws), Counter(grams(ws))) for i, ws in told if ws]
    index = defaultdict(set)
    for n, (_, _, c) in enumerate(shingled):
        for g in c:
            index[g].add(n)
    for doc, text in rows:
        ws = words((text or "").translate(UPPER))
        for n in {n for g in grams(ws) for n in index.get(g, ())}:
            item, size, want = shingled[n]
            for at in range(max(1, len(ws) - size + 1)):
                have = Counter(grams(ws[at : at + size]))
                common = sum((have & want).values())
                value = common / (sum(have.values()) + sum(want.values()) - common)
                if value >= similar and value > out.get((doc, item), 0):
                    out[doc, item] = value
    return out
