"""Plain versions of the corpus operators, one row after another."""

import hashlib
import re
import zlib

import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def simhash(docs, radius=3):
    """{id: (fingerprint, component)} of [(id, text)]."""
    fps = {i: fingerprint(t) for i, t in docs}
    group = {i: i for i in fps}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(fps)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                group[y] = x
    return {i: (fps[i], root(i)) for i in ids}


def substring(docs, window=50):
    """[(id, n_words, n_removed, sha256)] in the order of docs."""
    first = {}
    for i, t in docs:
        if i is not None:
            w = words(t)
            for k in range(len(w) - window + 1):
                x = tuple(w[k : k + window])
                first[x] = min(first.get(x, i), i)
    out = []
    for i, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    w = words(text)
    text = text or ""
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    hit = set()
    for k, g in enumerate(grams):
        if grams.count(g) > 1:
            hit.update(range(k, k + 8))
    return len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def learned_bands(docs, labels, least_texts=50, tail=0.002, room=0.03):
    """[(bytes, low, high)] of length classes, from the good texts outside the held-out fold."""
    import numpy as np
    import zstandard

    wide = [(0, 0.40, 2.00), (128, 0.34, 1.10), (256, 0.30, 0.92), (512, 0.28, 0.82), (1024, 0.26, 0.74), (2048, 0.24, 0.70), (8192, 0.20, 0.68)]
    z = zstandard.ZstdCompressor(level=3)
    good = {t for i, t in docs if i is not None and labels.get(i) == 1 and zlib.crc32(str(i).encode()) % 5 and t}
    found = [(len(t.encode()), len(z.compress(t.encode())) / len(t.encode())) for t in good if not quality(t)[-1]]
    out = []
    for k, (least, low, high) in enumerate(wide):
        own = [r for n, r in found if n >= least and (k + 1 == len(wide) or n < wide[k + 1][0])]
        if len(own) >= least_texts:
            low, high = np.quantile(own, tail) * (1 - room), np.quantile(own, 1 - tail) * (1 + room)
        out.append((least, low, high))
    return out


def kept(text, bands):
    """Whether the base rules and the bands of the whole text and of its 4 KB chunks let it through."""
    import zstandard

    if quality(text)[-1]:
        return False
    z, data = zstandard.ZstdCompressor(level=3), text.encode()

    def outside(piece):
        low, high = [b[1:] for b in bands if len(piece) >= b[0]][-1]
        return not low <= len(z.compress(piece)) / len(piece) <= high

    pieces = [data[k : k + 4096] for k in range(0, len(data), 4096)]
    if len(pieces) > 1 and len(pieces[-1]) < 2048:
        pieces[-2:] = [pieces[-2] + pieces[-1]]
    return not outside(data) and 4 * sum(len(p) for p in pieces if outside(p)) <= len(data)


def items(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def decontamination(docs, bench, window=10):
    """[(id, n_words, n_hit, n_items, sha256, contaminated)]."""
    grams = {}
    for i, t in bench:
        w = items(t)
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            grams.setdefault(tuple(w[k : k + m]), set()).add(str(i))
    out = []
    for i, t in docs:
        w = items(t)
        hit, met = set(), set()
        for m in {len(g) for g in grams}:
            for k in range(len(w) - m + 1):
                found = grams.get(tuple(w[k : k + m]))
                if found:
                    hit.update(range(k, k + m))
                    met |= found
        out.append((i, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return out


def tokens(docs, tokenizer, end=0, ascending=True):
    """[(id, start, n_tokens, crc32)] in ascending order of ids, or in that of docs."""
    import struct

    at, out = 0, []
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or "")) if ascending else docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, end]
        out.append((i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    return out
