"""Plain Python versions of the operators, which the tests hold them to. Rows are (doc_id, text, source)."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(text):
    x = text or ""
    w = WORD.findall(x)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n, covered = Counter(windows), set()
    for i, z in enumerate(windows):
        if n[z] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [l for l in x.split("\n") if WORD.search(l)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(covered)


def frequent_lines(rows, max_docs=20, copies=True):
    """(host, line) that more than max_docs documents of the host hold."""
    held = defaultdict(set)
    for i, t, s in rows:
        for l in (t or "").split("\n"):
            if WORD.search(l):
                held[s, " ".join(WORD.findall(l)).lower()].add((i, t) if copies else t)
    return {k for k, v in held.items() if len(v) > max_docs}


def rules(rows, max_docs=20, copies=True):
    """By row: (words removed, kept, text without the removed lines)."""
    frequent, out = frequent_lines(rows, max_docs, copies), []
    for _, t, s in rows:
        n, _, _, _, again = base(t)
        gone = [l for l in (t or "").split("\n") if (s, " ".join(WORD.findall(l)).lower()) in frequent]
        lost = sum(len(WORD.findall(l)) for l in gone)
        kept = not (n < 50 or 100 * again > 50 * n) and n - lost >= 25 and 2 * (n - lost) >= n
        out.append((lost, kept, None if t is None else "\n".join(l for l in t.split("\n") if (s, " ".join(WORD.findall(l)).lower()) not in frequent)))
    return out


def template_lines(rows, copies=True, least=3):
    """By row: the places of the lines of recurring templates, but for the first document of each."""
    docs = {}
    for i, t, _ in rows:
        if t is not None:
            k = (i, t) if copies else t
            docs[k] = min(docs.get(k, i), i)
    lines, leaves = [], defaultdict(Counter)
    for i, t, _ in rows:
        for p, line in enumerate((t or "").split("\n")):
            w = tuple("<*>" if re.search("[0-9]", x) else x for x in WORD.findall(line))
            if w:
                lines.append(((i, t) if copies else t, p, w))
                leaves[len(w), w[:4]][w] += 1
    of = {}
    for key, left in leaves.items():
        left = dict(left)
        while left:
            lead = max(left, key=lambda w: (left[w], " ".join(w)))
            for w in [w for w in left if 100 * sum(a == b for a, b in zip(w, lead, strict=True)) >= 70 * key[0]]:
                of[w] = lead
                del left[w]
    holders = defaultdict(set)
    for d, _, w in lines:
        holders[of[w]].add(d)
    first = {k: min(v, key=lambda d: (docs[d], d)) for k, v in holders.items() if len(v) >= least}
    gone = defaultdict(set)
    for d, p, w in lines:
        if of[w] in first and first[of[w]] != d:
            gone[d].add(p)
    return [sorted(gone[(i, t) if copies else t]) for i, t, _ in rows]


def without(text, places):
    return None if text is None else "\n".join(l for p, l in enumerate(text.split("\n")) if p not in set(places))


def sets_of(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_duplicates(rows):
    """(set size, component) by doc_id."""
    s = {i: sets_of(t) for i, t, _ in rows}
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(s)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(s[a] & s[b])
            if n and 100 * n >= 75 * (len(s[a]) + len(s[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(i)) for i in s}


def fill(sizes, weights, budget, cap=3):
    """Targets by bisection on the water level: each is the level times its weight, at most cap times its size."""
    low, high = 0.0, 2 * cap * max([1, *sizes]) / min(weights) + 1
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(level * w, cap * n) for w, n in zip(weights, sizes, strict=True)) < budget:
            low = level
        else:
            high = level
    return [min(high * w, cap * n) for w, n in zip(weights, sizes, strict=True)]


def times(rows, seed=97, bins=1024, cap=3):
    """How often the mix takes each row."""
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, (_, _, x) in zip(size, rows, strict=True) if x == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target = dict(zip(names, fill([total[s] for s in names], [weight[s] for s in names], sum(size), cap), strict=True))
    out = [0] * len(rows)
    for s in names:
        rate = min(cap, target[s] / total[s]) if total[s] else 0
        rate = round(rate) if abs(rate - round(rate)) < 1e-9 else rate
        classes = defaultdict(list)
        for k, (i, t, x) in enumerate(rows):
            if x == s:
                draw = int(hashlib.md5(f"{seed}|{'' if i is None else i}|{t or ''}".encode()).hexdigest()[:8], 16) % bins
                classes[max(1, size[k].bit_length())].append((draw, k))
        carry = 0.0
        for c in sorted(classes, reverse=True):
            own = classes[c]
            goal = carry + (rate - int(rate)) * sum(size[k] for _, k in own)
            ends = [0, *sorted({d + 1 for d, _ in own})]
            taken = {e: sum(size[k] for d, k in own if d < e) for e in ends}
            best = min(ends, key=lambda e: (abs(taken[e] - goal), e))
            carry = goal - taken[best]
            for d, k in own:
                out[k] = int(rate) + (d < best)
    return out
