"""Plain versions of the corpus operators, for small tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import xxhash

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def fingerprint(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(rows, bits=2):
    """doc_id -> (fingerprint, component)."""
    prints = {d: fingerprint(t) for d, t in rows}
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    values = np.array([prints[d] for d in ids], np.uint64)
    for i, d in enumerate(ids):
        far = np.unpackbits((values[i + 1 :] ^ values[i]).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=1)
        for j in np.nonzero(far <= bits)[0]:
            a, b = sorted((find(d), find(ids[i + 1 + j])))
            root[b] = a
    return {d: (f"{prints[d]:016x}", find(d)) for d in ids}


def contamination(rows, items, size=10):
    """doc_id -> (n_words, n_hit, sorted item ids as strings)."""
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[s : s + n])].add(str(item))
    lengths = {len(k) for k in windows}
    out = {}
    for d, text in rows:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[s : s + n]))) is not None:
                    hit.update(range(s, s + n))
                    found |= got
        out[d] = (len(w), len(hit), sorted(found))
    return out


def licenses(rows):
    """doc_id -> (n_words, n_base, first, last, base labels)."""
    out = {}
    for d, text in rows:
        w, places, labels = words(text), [], set()
        for phrase, label in BASE.items():
            p = phrase.split()
            at = [s for s in range(len(w) - len(p) + 1) if w[s : s + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        out[d] = (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
    return out


def license_labels(text, notices, least=0.75, drift=2):
    """All labels and the best score, by the longest chain of word pairs from every start."""
    w = words(text)
    labels, best = set(), 0.0
    for phrase, label in BASE.items():
        p = phrase.split()
        if any(w[s : s + len(p)] == p for s in range(len(w))):
            labels, best = labels | {label}, 1.0
    for label, wording in notices:
        t = wording.split()
        hits = [(i, j) for i in range(len(w) - 1) for j in range(len(t) - 1) if w[i : i + 2] == t[j : j + 2]]
        for low in {i - j for i, j in hits}:
            near = [(i, j) for i, j in hits if low <= i - j <= low + drift]
            length = {}
            for i, j in near:
                length[i, j] = 1 + max((n for (a, b), n in length.items() if a < i and b < j), default=0)
            score = max(length.values()) / (len(t) - 1)
            if score >= least:
                labels, best = labels | {label}, max(best, score)
    return ",".join(sorted(labels)), best


def repeats(rows, size=50):
    """doc_id -> (n_bytes, n_removed, n_spans, sha256 of what is left)."""
    first = {}
    data = {d: (t or "").encode() for d, t in rows}
    for d in sorted(data):
        for s in range(len(data[d]) - size + 1):
            first.setdefault(data[d][s : s + size], d)
    out = {}
    for d, b in data.items():
        gone = bytearray(len(b))
        for s in range(len(b) - size + 1):
            if first[b[s : s + size]] < d:
                gone[s : s + size] = b"\1" * size
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def pieces(rows, encode, size=2048):
    """(doc_id, piece) -> (start, length, crc)."""
    out = {}
    for d, text in rows:
        ids = [*encode(text or ""), 0]
        first = len(ids) % size or size
        cuts = [0, *range(first, len(ids) + 1, size)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out[d, n] = (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    return out


def neighbours(vectors, queries, k=20):
    """query id -> [(vec_id, score)], nearest first."""
    ids = np.array(sorted(vectors))
    matrix = np.array([vectors[i] for i in ids], float)
    out = {}
    for q in queries:
        score = np.cumsum(matrix * np.array(vectors[q], float), axis=1)[:, -1]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(score[i])) for i in order]
    return out


def sha(*values):
    """Hash of values as the manifest writes them."""
    out = "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)
    return hashlib.sha256(out.encode()).hexdigest()


def tree(leaves):
    """All levels of a tree, leaves first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([hashlib.sha256("".join(below[i : i + 16]).encode()).hexdigest() for i in range(0, len(below), 16)])
    return levels


def manifest(rows, changed):
    """doc_id -> (leaf, subroot, root, proof, folded root); rows: (doc_id, source, lang, n_chars, text)."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    members = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0], sha(*r))) for s in sources}
    trees = {s: tree([sha(*r) for r in members[s]]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    out = {}
    for number, s in enumerate(sources):
        for place, r in enumerate(members[s]):
            others, now = "", sha(*r[:4], r[4].translate(LOWER) if r[4] is not None else None) if changed(r[0]) else sha(*r)
            for levels, at in ((trees[s], place), (top, number)):
                for level in levels[:-1]:
                    first = at - at % 16
                    run = list(level[first : first + 16])
                    others += "".join(run[: at % 16] + run[at % 16 + 1 :])
                    run[at % 16] = now
                    now, at = hashlib.sha256("".join(run).encode()).hexdigest(), at // 16
            out[r[0]] = (sha(*r), trees[s][-1][0], top[-1][0], hashlib.sha256(others.encode()).hexdigest(), now)
    return out


def phrases(rows, top=2000, least=10):
    """Sorted (lang, rank, phrase, a, l, r, n, score); rows: (lang, text)."""
    f, n = defaultdict(int), defaultdict(int)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for s in range(len(w) - k + 1):
                    f[lang, tuple(w[s : s + k])] += 1
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    scored = defaultdict(list)
    for (lang, p), a in found.items():
        around = [b for (other, q), b in found.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= 50 * a for b in around):
            continue
        cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        scored[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, those in scored.items() for rank, (s, a, p, l, r) in enumerate(sorted(those)[:top], 1))


def revisits(rows, least=1000):
    """page_id -> (bytes, sha1, type, refers to)."""
    data = {i: (t or "").encode() for i, t in rows}
    out = {}
    for i, b in data.items():
        first = max(j for j, other in data.items() if other == b) if len(b) >= least else i
        out[i] = (len(b), hashlib.sha1(b).hexdigest(), "response" if first == i else "revisit", None if first == i else first)
    return out
