"""Plain single-process answers to the operators' contracts."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng: random.Random, n: int) -> str:
    sounds = "ka lo mi ter san vel dor in é ün".split()
    return " ".join("".join(rng.choice(sounds) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(seed: int = 3) -> list[tuple[int, str | None]]:
    """Documents with exact copies, near copies, shared passages, repeats inside one text, and edge cases."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(20, 300)) for _ in range(40)]
    passage = prose(rng, 120)
    texts: list[str | None] = [None, "", " \n\t ", "one two", "One  TWO", "a b c d e", "x" * 3000, (passage + " ") * 3, base[0] + "\n" + base[0]]
    texts += base
    for k in range(12):
        texts.append(base[1])
        words = base[2].split()
        words[rng.randrange(len(words))] = f"w{k}"
        texts.append(" ".join(words))
        texts.append(prose(rng, 30) + " " + passage + " " + prose(rng, 25))
    for k in range(30):  # steps of a chain, each near the one before
        words = base[3].split()
        for j in range(k * 2):
            words[(j * 7) % len(words)] = f"z{j}"
        texts.append(" ".join(words))
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(100 + 7 * i, texts[i]) for i in order]


def shingle_set(text: str | None) -> frozenset:
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def near_classes(docs: list[tuple[int, str | None]], percent: int = 80) -> dict[int, tuple[int, int]]:
    sets = {d: shingle_set(t) for d, t in docs}
    up = {d: d for d in sets}

    def find(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def repeats(docs: list[tuple[int, str | None]], length: int = 400, min_words: int = 0) -> dict[int, tuple[int, int, int, str]]:
    count: Counter = Counter()
    for _, t in docs:
        b = (t or "").encode()
        count.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = {}
    for d, t in docs:
        b = (t or "").encode()
        hit = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                hit[p : p + length] = b"\1" * length
        for run in list(re.finditer(b"\1+", hit)):
            if len(b[slice(*run.span())].split()) < min_words:
                hit[slice(*run.span())] = bytes(run.end() - run.start())
        kept = bytes(x for x, h in zip(b, hit, strict=True) if not h)
        spans = sum(1 for i in range(len(b)) if hit[i] and (not i or not hit[i - 1]))
        out[d] = (len(b), sum(hit), spans, hashlib.sha256(kept).hexdigest())
    return out


def base_figures(text: str | None) -> tuple[int, int, int, int, int]:
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)
