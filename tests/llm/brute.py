"""Plain versions of the operators, and a table of awkward documents."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = "the quick brown fox jumps over a lazy dog while seven wizards box with liquid jugs of very old wine near the quiet river bank every single morning before dawn".split()


def awkward():
    """(doc_id, text, source): nulls, empty, blanks, long, repeated rows and ids, near copies, shared passages."""
    passage = " ".join(BASE) + " and so the long passage goes on for quite a while longer"
    near = [w + str(n % 5) for n, w in enumerate(BASE * 4)]
    rows = [
        (1, None, "b"), (2, "", "a"), (3, " \t\n", None), (4, "x", "a"), (5, passage, "a"), (6, passage.replace(" ", "\n"), "b"), (7, passage + "  ", "b"),
        (7, passage + "  ", "b"), (8, "Prefix here. " + passage + " suffix", "c"), (9, " ".join(near), "c"), (10, " ".join([*near[:-1], "changed"]).upper(), None),
        (11, " ".join([*near[:50], *"w1 w2 w3 w4 w5 w6 w7 w8 w9".split(), *near[50:]]), "a"), (12, "aaaa " * 300, "a"), (13, "q" * 5000, "d"), (14, "é à ü 日本 🎉 " * 30, "d"),
        (15, "<|endoftext|> a <|endoftext|>b\n\nc  d", "d"), (None, passage, "a"), (None, None, None), (16, "one two three", "a"), (17, "one  two\tthree", "b"), (18, "ONE two three", "e"),
        (19, "a\nb\na\n \nb\na b c d e f g h a b c d e f g h", "e"), (20, " ".join(f"u{n}" for n in range(3000)), "e"),
    ]
    return rows


SCHEMA = "doc_id long, text string, source string"


def clashing(df):
    """The same rows with columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    names = ["_key", "_text", "word", "mask", "_hit", "_len", "_full", "_salt", "_group", "size", "n", "kept", "_doc", "_src", "_hash"]
    return df.withColumns({c: F.lit("x") for c in names})


def sets(rows):
    out = []
    for _, t, *_ in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return out


def components(rows):
    """(key, shingles, component) by comparing all pairs."""
    s, root = sets(rows), {k: k for k, *_ in rows if k is not None}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, *_) in enumerate(rows):
        for j, (b, *_) in enumerate(rows[:i]):
            if a is not None and b is not None and s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return [(k, len(x), None if k is None else top(k)) for (k, *_), x in zip(rows, s, strict=True)]


def exact(rows):
    """Groups by normal text: (key, keep, size, sha)."""
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, *_ in rows]
    groups = defaultdict(list)
    for (k, t, *_), n in zip(rows, norm, strict=True):
        groups[n].append((-len(t or ""), k is None, k or 0, k))
    return [(k, min(groups[n])[3], len(groups[n]), hashlib.sha256(n.encode()).hexdigest()) for (k, *_), n in zip(rows, norm, strict=True)]


def stripped(rows):
    """(key, bytes, removed, spans, sha) of each row, in order of the row."""
    least, texts = {}, [(t or "").encode() for _, t, *_ in rows]
    order = [2**63 if k is None else k for k, *_ in rows]
    for o, b in zip(order, texts, strict=True):
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            least[w] = min(o, least.get(w, o))
    out = []
    for (k, *_), o, b in zip(rows, order, texts, strict=True):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if least[b[p : p + 50]] < o:
                gone[p : p + 50] = True
        left = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int(np.count_nonzero(gone & ~np.concatenate(([False], gone[:-1])))) if len(b) else 0
        out.append((k, len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


def base_counts(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def key(row):
    return tuple((x is None, 0 if x is None else x) for x in row)
