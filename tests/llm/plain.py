"""Plain versions of the operators, one document after the other, and small documents to try them on."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\x0c\r"


def low(text):
    return (text or "").translate(_LOWER)


def documents(seed=0, n=60):
    """Rows (doc_id, text): new texts, copies, near copies, shared passages, null, empty and very long ones."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdéßñ日") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    some = lambda k: [rng.choice(words) for _ in range(k)]
    passage = some(30)
    out: list[tuple[int, str | None]] = []
    for k in range(n):
        kind = rng.random()
        if k == 3:
            text = None
        elif k == 4:
            text = ""
        elif k == 5:
            text = " \n\t "
        elif k == 6:
            text = " ".join(some(8000))
        elif kind < 0.2 and out:
            text = rng.choice(out)[1]
        elif kind < 0.45 and out:
            old = (rng.choice(out)[1] or "x").split(" ")[:400]
            for _ in range(rng.randint(1, 3)):
                old[rng.randrange(len(old))] = rng.choice(words)
            text = " ".join(old)
        elif kind < 0.6:
            text = " ".join(some(rng.randint(0, 20)) + passage + some(rng.randint(0, 20)))
        else:
            text = rng.choice([" ", "\n"]).join(some(rng.randint(1, 150)))
        if text and rng.random() < 0.3:
            text = text.upper() if rng.random() < 0.3 else f"  {text}\r\n"
        out.append((k * 3 + 1, text))
    return out


def repeats(rows, window):
    first, texts = {}, [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in sorted(texts, key=lambda r: r[0]):
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def components(rows, percent, width):
    sets = []
    for i, t in rows:
        w = WORD.findall(low(t))
        sets.append((i, {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def lines(rows, edits, least):
    first, places = {}, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        for k, line in enumerate((t or "").split("\n")):
            s = line.strip(SPACE)
            if len(s) >= least:
                first.setdefault(s, (i, k))
                places.append((i, k, s))
    linked = defaultdict(set)
    for a in first:
        for b in first:
            if a < b and abs(len(a) - len(b)) <= edits and distance(a, b) <= edits:
                linked[a].add(b)
                linked[b].add(a)
    late = {s for s in linked if any(first[o] < first[s] for o in linked[s])}
    told, gone = defaultdict(lambda: [0, 0, 0, 0]), set()
    for i, k, s in places:
        dropped = s in late or first[s] != (i, k)
        told[i] = [x + y for x, y in zip(told[i], (1, dropped, s in late, len(linked[s])), strict=True)]
        if dropped:
            gone.add((i, k))
    return sorted((i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone), *told[i]) for i, t in rows)


def contaminated(rows, items, window):
    wanted = defaultdict(set)
    for item, t in items:
        w = ALNUM.findall(low(t))
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if n else ():
            wanted[tuple(w[k : k + n])].update([] if item is None else [str(item)])
    out = []
    for i, t in rows:
        w, hit, found = ALNUM.findall(low(t)), set(), set()
        for n in {len(x) for x in wanted}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wanted:
                    hit |= set(range(k, k + n))
                    found |= wanted[x]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def quality(rows):
    out = []
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        counts, covered = Counter(windows), set()
        for k, x in enumerate(windows):
            if counts[x] > 1:
                covered |= set(range(k, k + 5))
        held = [x for x in t.split("\n") if WORD.search(x)]
        n = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(held) - len(set(held)), len(covered))
        out.append((i, *n, n[0] < 10 or 100 * n[4] > 20 * n[0]))
    return sorted(out)


def targets(sizes, cap=3):
    """Targets of sources by sharing and sharing again, until none is over its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    out, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= cap * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        out |= {s: cap * sizes[s] for s in over}
        left -= sum(cap * sizes[s] for s in over)
        open_ -= over
    return out
