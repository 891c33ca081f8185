"""Plain versions of the operators, for small inputs."""

import hashlib
import itertools
import re
import string
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def without_repeats(rows, window=20):
    seen, out = set(), []
    for i, text in sorted(rows):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for p in range(len(words) - window + 1):
            key = tuple(words[p : p + window])
            if key in seen:
                gone[p : p + window] = [True] * window
            seen.add(key)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text, k):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def near(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [(i, len(sets[i]), find(i), find(i) == i) for i in ids]


def exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return sorted((i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


WS = " \t\n\x0b\x0c\r"
FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}
NAME = {"u": "user", "a": "assistant"}


def conversations(rows):
    """{conv_id: the columns of op13 after it} of rows (conv_id, turn, role, text)."""
    convs = {}
    for c, t, r, x in rows:
        kept = convs.setdefault(c, [])
        draw = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if draw == 1 else re.sub("[.!?]", "", x) if draw == 2 else x
        kept += [(t, "user" if draw == 4 else r, x)] * {0: 0, 3: 2}.get(draw, 1)
    return {c: conversation(kept) for c, kept in convs.items()}


def with_insertions(best):
    """Role strings (by their last letter) with the best {cost, audit, lines}, and what one or two insertions reach from them."""
    for _ in range(4):
        for q, (c, a, lines) in list(best.items()):
            for to in set(FOLLOWS[q]) - {"s"}:
                new = (c + 2, a + "I", [*lines, NAME[to] + ":"])
                if to not in best or new[:2] < best[to][:2]:
                    best[to] = new
    return best


def conversation(rows):
    rows = sorted(rows, key=lambda y: (y[0] is not None, y[0] or 0, y[1], hashlib.md5(y[2].encode()).hexdigest()))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults = set(), []
    for _, r, x in rows:
        held = x.strip(WS)
        faults.append("b" if not held else "d" if (r, x) in seen else "t" if held[-1] not in ".!?" else "-")
        seen.add((r, x))
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    best = with_insertions({"": (0, "", [])})
    for (_, r, x), f in zip(rows, faults):
        ways = []
        for q, (c, a, lines) in best.items():
            ways.append((q, (c + 3, a + "D", lines)))
            if f in "t-":
                c += f == "t"
                ways += [(r[:1], (c, a + "K", [*lines, f"{r}:{x}"]))] * (r[:1] in [*FOLLOWS[q]])
                ways += [(to, (c + 2, a + "R", [*lines, f"{NAME[to]}:{x}"])) for to in FOLLOWS[q] if to != "s"]
        best = {}
        for q, new in ways:
            if q not in best or new[:2] < best[q][:2]:
                best[q] = new
        best = with_insertions(best)
    c, a, lines = min(best[q] for q in ("", "a") if q in best)
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, c, a, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def alignment(rows, tokens_a, tokens_b):
    """{doc_id: the columns of op12 after it} of rows (doc_id, text), given each text's [(id, bytes)] by either tokenizer."""
    out, links = {}, {}
    for i, text in rows:
        a, b = (tokens_a(text), tokens_b(text)) if text else ([], [])
        raw = b" " + (text or "").encode()
        if not text or b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            a = b = []
        ends = [list(itertools.accumulate(len(x) for _, x in side)) for side in (a, b)]
        both = sorted(set(ends[0]) & set(ends[1]))
        groups = [[[str(t) for (t, _), e in zip(side, at) if low < e <= high] for side, at in zip((a, b), ends)] for low, high in zip([0, *both], both)]
        links[i] = [(x, y) for (x, _), e in zip(a, ends[0]) for (y, _), d in zip(b, ends[1]) if e == d]
        spelled = ";".join("|".join(",".join(side) for side in g) for g in groups)
        out[i] = (len(a), len(b), len(groups), len(links[i]), hashlib.sha256(spelled.encode()).hexdigest() if a else "")
    count = Counter(itertools.chain.from_iterable(links.values()))
    top = {}
    for (_, y), n in count.items():
        top[y] = max(n, top.get(y, 0))
    return {i: (*v[:4], sum(count[p] == top[p[1]] for p in links[i]), sum(count[p] for p in links[i]), v[4]) for i, v in out.items()}
