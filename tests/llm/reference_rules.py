"""Plain Python versions of the contracts, for comparison on small tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    win = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = set()
    for i in range(len(w) - 4):
        if win[tuple(w[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    out = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))
    return out + (len(w) < 10 or 100 * len(hit) > 20 * len(w),)


def pii(text):
    text = text or ""
    spans = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        spans.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            spans.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d[::-1])) % 10 == 0:
            spans.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            spans.append((m.start(), 3, m.end(), "phone"))
    spans.sort()
    n = Counter(s[3] for s in spans)
    return (n["email"], n["ip"], n["card"], n["phone"], sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)))


def simhash(text):
    import xxhash

    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(t)
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, fps, threshold=3):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    f = np.array(fps, np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(f[i] ^ f[i + 1 :]) <= threshold):
            root[find(i)] = find(i + 1 + int(j))
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [low.get(find(i)) for i in range(len(ids))]


def covered(units, docs, length):
    """Per document the units covered by a window of `length` that also starts earlier; docs in id order."""
    seen, out = set(), []
    for d in docs:
        hit = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            w = d[i : i + length] if isinstance(d, bytes) else tuple(d[i : i + length])
            if w in seen:
                hit[i : i + length] = True
            seen.add(w)
        out.append(hit)
    return out


def bytes_dedup(texts):
    docs = [(t or "").encode() for t in texts]
    res = []
    for d, hit in zip(docs, covered(None, docs, 100)):
        kept = np.frombuffer(d, np.uint8)[~hit].tobytes()
        spans = int(np.sum(np.diff(np.r_[0, hit.astype(int)]) == 1))
        res.append((len(d), int(hit.sum()), spans, sha(kept)))
    return res


def phrase_dedup(texts):
    docs = [WORD.findall(t or "") for t in texts]
    return [(len(d), int(hit.sum()), sha(" ".join(w for w, x in zip(d, hit) if not x))) for d, hit in zip(docs, covered(None, docs, 20))]


def word_ids(texts, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())
