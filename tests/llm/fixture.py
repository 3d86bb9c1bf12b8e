"""A small corpus with the odd cases, and plain-Python versions of the operators."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def corpus(seed=7):
    """(doc_id, text): random texts, copies, near copies, chains of near copies, a shared passage, blanks, nulls, a very long text."""
    rnd = random.Random(seed)
    stock = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8))) for _ in range(300)] + ["Zürich", "naïve", "日本", "The", "THE"]

    def text(n):
        return " ".join(rnd.choice(stock) for _ in range(n))

    passage, rows = text(45), []
    for i in range(30):
        rows.append(text(rnd.randrange(1, 120)))
    base = text(150)
    rows += [base] * 6
    for i in range(40):
        parts = base.split()
        for _ in range(rnd.randrange(1, 9)):
            parts[rnd.randrange(len(parts))] = rnd.choice(stock)
        rows.append(" ".join(parts))
    for i in range(12):
        rows.append(text(30) + "\n" + passage + " \t" + text(rnd.randrange(10, 40)))
    step = text(100).split()
    for i in range(10):  # each is near to the next, the ends are far apart
        step = step[:]
        for j in range(2):
            step[i * 9 + j * 4] = f"new{i}x{j}"
        rows.append(" ".join(step))
    loop = text(25)
    rows += [loop + " " + loop, "same " * 60, "", None, " \n\t ", "one", "two words", "three little words", text(9000), "a b c\x1cd"]
    order = list(range(1000, 1000 + 3 * len(rows), 3))
    rnd.shuffle(order)
    return list(zip(order, rows))


def keep_words(docs, window):
    """(n_words, n_removed, kept words) by id: words covered by windows that start earlier go."""
    first, split = {}, {i: words(t) for i, t in docs}
    for i in sorted(split):
        for s in range(len(split[i]) - window + 1):
            first.setdefault(tuple(split[i][s : s + window]), (i, s))
    out = {}
    for i, w in split.items():
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] != (i, s):
                gone.update(range(s, s + window))
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def shingles(text, n):
    w = words(text, True)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def groups(docs, n, percent):
    """(set size, least id of the component) by id."""
    sets = {i: shingles(t, n) for i, t in docs}
    head = {i: i for i in sets}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            c = len(a & b)
            if c and 100 * c >= percent * (len(a) + len(b) - c):
                p, q = find(i), find(j)
                head[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}
