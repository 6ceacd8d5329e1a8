"""Plain statements of the operators' results, for small inputs."""

import hashlib
import math
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    w = WORD.findall((text or "").translate(FOLD))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, bits=3):
    """Index of the first member of each item's group."""
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits and (a := find(i)) != (b := find(j)):
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_bangs, n_lines)."""
    t = text or ""
    w = WORD.findall(t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(grams)
    covered = {j for i, g in enumerate(grams) if many[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), t.count("!"), t.count("\n") + 1


def failed(m):
    n, chars, symbols, dup, rep, bangs, lines = m
    rules = [n < 50, 100 * rep > 50 * n, 10 * symbols > n, 5 * dup > 2 * lines, chars < 3 * n or chars > 10 * n, 2 * bangs > n]
    return sum(1 << i for i, x in enumerate(rules) if x)


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def contamination(text, items):
    """(n_words, n_hit, item ids); items: [(id, text)]."""
    w = plain_words(text)
    hit, found = set(), set()
    for name, item in items:
        if name is None or item is None:
            continue
        v = plain_words(item)
        k = min(8, len(v))
        for s in range(len(v) - k + 1) if k else ():
            for i in range(len(w) - k + 1):
                if w[i : i + k] == v[s : s + k]:
                    hit.update(range(i, i + k))
                    found.add(str(name))
    return len(w), len(hit), sorted(found)


def level_of(need, sizes):
    """The level at which the expected words of (size, measure) with p = min(1, level * measure) are ``need``, by rounds."""
    sure, level = set(), 0.0
    while need > 0 and len(sure) < len(sizes):
        rest = [x for i, x in enumerate(sizes) if i not in sure]
        level = (need - sum(sizes[i][0] for i in sure)) / sum(z * m for z, m in rest)
        more = {i for i, (_, m) in enumerate(sizes) if level * m > 1} - sure
        if not more:
            break
        sure |= more
    return level


def mix(rows):
    """Copies of each of the rows (id, source, text), by the same plan and order."""
    size = [len(WORD.findall(t or "")) for _, _, t in rows]
    sources = sorted({s for _, s, _ in rows if s is not None}) + ([None] if any(s is None for _, s, _ in rows) else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    total = {s: sum(z for z, r in zip(size, rows, strict=True) if r[1] == s) for s in sources}
    open_, target, left = set(sources), {}, sum(total.values())
    while True:  # water-filling by rounds
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * total[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3.0 * total[s]
            left -= 3 * total[s]
        open_ -= over
    copies = [0] * len(rows)
    for s in sources:
        mine = [i for i, r in enumerate(rows) if r[1] == s]
        whole = math.floor(target[s] / total[s]) if total[s] else 0
        need = target[s] - whole * total[s]
        level = level_of(need, [(size[i], size[i].bit_length()) for i in mine if size[i]])
        order = []
        for i in mine:
            p = min(1.0, level * max(1, size[i].bit_length()))
            key = f"{'null' if rows[i][0] is None else rows[i][0]}:{hashlib.md5((rows[i][2] or '').encode()).hexdigest()}"
            u = (int(hashlib.md5(f"7:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            odds = 1.0 if p <= 0 else 0.0 if p >= 1 else (u / (1 - u)) / (p / (1 - p))
            order.append((odds if p <= 0 or p >= 1 else odds / (1 + odds), key, size[i], i))
        upto = 0
        for _, _, z, i in sorted(order):
            upto += z
            copies[i] = whole + (need > 0 and 2 * upto - z <= 2 * need)
    return size, total, target, copies


def repeats(texts, window=200):
    """(n_bytes, n_removed, n_spans, kept) of each text."""
    data = [(t or "").encode() for t in texts]
    many = Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - window + 1):
            if many[d[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        spans = len([x for x in bytes(gone).split(b"\0") if x])
        out.append((len(d), gone.count(1), spans, bytes(c for c, g in zip(d, gone, strict=True) if not g)))
    return out


def secrets(text):
    """Base spans (start, kind, end) of a text."""
    t = text or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(found)


def near_copies(a, b, similarity=0.8):
    """Whether two texts are alike, word by word: by their sets of five-word shingles or by the words these cover."""
    cut, words = [], []
    for t in (a, b):
        w = WORD.findall((t or "").translate(FOLD))
        cut.append([tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else [])
    x, y = map(set, cut)
    if not x or not y:
        return x == y
    if len(x & y) >= similarity * len(x | y):
        return True
    for grams in cut:
        first = {g: i for i, g in reversed(list(enumerate(grams)))}
        every = {i + k for i in first.values() for k in range(5)}
        held = {first[g] + k for g in x & y for k in range(5)}
        words.append(len(held) >= similarity * len(every))
    return all(words)
