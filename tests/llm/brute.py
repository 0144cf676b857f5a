"""Plain single-process versions of the corpus operators, and awkward documents to try them on."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

WHITE = " \t\n\v\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return [w.translate(LOWER) for w in found] if lower else found


def awkward(seed=0, n=120, width=60):
    """(doc_id, text) rows: nulls, empty and long texts, white space of all kinds, copies, near copies,
    a group that is a third of all rows, ids that repeat, and rows that repeat."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeÀß語 "[:8]) for _ in range(rng.randint(1, 6))) or "x" for _ in range(80)]
    sentence = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    rows, hot, passage = [], sentence(width), sentence(25)
    for i in range(n):
        kind = rng.randint(0, 9)
        if kind < 3:
            text = hot
        elif kind == 3:
            text = " ".join(w if rng.random() > 0.03 else "Zed" for w in hot.split(" "))
        elif kind == 4:
            text = sentence(rng.randint(0, 30)) + rng.choice(["\n", " ", "\t\v"]) + passage + "\n" + sentence(rng.randint(0, 30))
        elif kind == 5:
            text = rng.choice([None, "", " ", "\n\n", "one", "One two", " \u0085", "a　b", "x" * 300])
        elif kind == 6:
            text = "\n".join(rng.choice(["Shared Line", " shared line\r", "other", "", sentence(4)]) for _ in range(6))
        else:
            text = sentence(rng.randint(1, 2 * width))
        rows.append((i, text))
    rows.append((n, sentence(4000)))  # long
    rows.append((n + 1, (sentence(7) + " ") * 60))  # repeats itself
    rows += [rows[5], rows[5], rows[n]]  # repeated rows
    rows += [(7, sentence(40)), (7, hot), (None, hot), (None, None), (None, sentence(50))]
    rng.shuffle(rows)
    return rows


def repeated_windows(rows, window):
    """[(doc_id, kept words, words, removed)]; the earliest (id, start), null id first, of a sequence stays."""
    order = lambda i: (i is not None, i or 0)
    first = {}
    for i, text in rows:
        w = words(text)
        for p in range(len(w) - window + 1):
            key, place = tuple(w[p : p + window]), (order(i), p)
            first[key] = min(first.get(key, place), place)
    out = []
    for i, text in rows:
        w = words(text)
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < (order(i), p):
                gone.update(range(p, p + window))
        out.append((i, " ".join(x for p, x in enumerate(w) if p not in gone), len(w), len(gone)))
    return out


def shingles(text, length):
    w = words(text, True)
    return {tuple(w[i : i + length]) for i in range(len(w) - length + 1)} if len(w) >= length else {tuple(w)} if w else set()


def near_duplicates(rows, length, percent=80):
    """[(doc_id, set size, component_id)]; rows are nodes, a component has its smallest id."""
    sets = [shingles(t, length) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        ids[find(i)].append(doc)
    lowest = {r: min((x for x in v if x is not None), default=None) for r, v in ids.items()}
    return [(doc, len(sets[i]), lowest[find(i)]) for i, (doc, _) in enumerate(rows)]


def contained(docs, items, length=5, percent=80):
    out = []
    for item, text in items:
        own = shingles(text, length)
        if own:
            n = len(next(iter(own)))
            for doc, t in docs:
                w = words(t, True)
                have = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
                if 100 * len(own & have) >= percent * len(own):
                    out.append((doc, item, len(own), len(own & have)))
    return out


def exact_duplicates(rows):
    """[(doc_id, keep_id, group_size, text)] and the number of rows that stay."""
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return [(i, keep[t], len(ids), t) for t, ids in groups.items() for i in ids], len(groups)


def frequent_lines(rows, least):
    key = lambda line: line.strip(WHITE).translate(LOWER)
    count = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and count[key(x)] >= least)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out
