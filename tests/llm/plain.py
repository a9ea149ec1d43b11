"""Plain versions of the corpus operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
from xxhash import xxh64_intdigest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def doc_rows(rows):
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]


def dedup_lines(docs, window=3):
    """{(id, text): (text, lines, removed)} of (id, text) rows with different ids."""
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda d: (d[0] is None, d[0])):
        if t is None:
            out[i, t] = (None, 0, 0)
            continue
        ls, gone = t.split("\n"), set()
        for p in range(len(ls) - window + 1):
            w = tuple(ls[p:p + window])
            if all(not x.strip(" ") for x in w):
                continue
            if w in seen:
                gone |= set(range(p, p + window))
            seen.add(w)
        out[i, t] = ("\n".join(x for k, x in enumerate(ls) if k not in gone), len(ls), len(gone))
    return out


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contamination(docs, items, span=10):
    """[(id, n_words, n_hit, item ids)] of (id, text) rows."""
    wins = defaultdict(set)
    for item, t in items:
        w = words(t)
        n = min(span, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[p:p + n])].add("" if item is None else str(item))
    sizes, out = {len(k) for k in wins}, []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (k := tuple(w[p:p + n])) in wins:
                    hit |= set(range(p, p + n))
                    ids |= wins[k]
        out.append((i, len(w), len(hit), sorted(ids)))
    return out


def simhash(text):
    ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", ws) if w]
    if not ws:
        return 0
    hs = [xxh64_intdigest(" ".join(ws[p:p + 3]).encode(), 42) for p in range(max(1, len(ws) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(keys, linked):
    """{position: smallest position linked} by linked(i, j)."""
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if linked(keys[i], keys[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(keys))]


def repeated_bytes(texts, length):
    """[(n_bytes, n_removed, n_spans, kept)] per text."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[p:p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - length + 1):
            if count[d[p:p + length]] > 1:
                gone[p:p + length] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        out.append((len(d), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), kept))
    return out


def secrets(text):
    """[(start, kind number, kind, end)] in order."""
    found = []
    for k, (kind, pattern, flags, fine) in enumerate((
            ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
             re.I | re.A, lambda m: len(m[2]) >= 12),
            ("access", r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 18),
            ("hex", r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 16))):
        found += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text or "", flags) if fine(m)]
    return sorted(found)


def sha1(data):
    return hashlib.sha1(data).hexdigest()
