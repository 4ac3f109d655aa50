"""Plain Python versions of the text operators, for small tables."""

import hashlib
import math
import re
import struct
import zlib

import xxhash

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def blank_words(t):
    return BLANK.findall(t or "")


def alnum_words(t):
    return ALNUM.findall(lower(t))


def quality(t):
    t = t or ""
    w = blank_words(t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if BLANK.search(x)]
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in t),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def keeps(t):
    q = quality(t)
    n = q["n_words"]
    return not (
        n < 50
        or 100 * q["n_repeat_words"] > 50 * n
        or 5 * q["n_symbols"] > n
        or q["word_chars"] < 2 * n
        or q["word_chars"] > 20 * n
        or (q["n_dup_lines"] >= 5 and 2 * q["n_dup_lines"] > q["n_lines"])
    )


def simhash(t):
    w = lower(t).encode().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(n, linked):
    """Class number of each of n things, given the linked pairs."""
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for i, j in linked:
        parent[find(i)] = find(j)
    return [find(i) for i in range(n)]


def hamming_classes(words, bits=4):
    n = len(words)
    return classes(n, ((i, j) for i in range(n) for j in range(i) if (words[i] ^ words[j]).bit_count() <= bits))


def contamination(t, items):
    """(n_words, n_hit, item ids, contaminated)."""
    w = alnum_words(t)
    hit, found = set(), set()
    for item, text in items:
        p = alnum_words(text)
        size = min(13, len(p))
        for k in range(len(p) - size + 1 if p else 0):
            for i in range(len(w) - size + 1):
                if w[i : i + size] == p[k : k + size]:
                    hit.update(range(i, i + size))
                    found.add("" if item is None else str(item))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


def targets(sizes):
    """Target of each source, from a dict source -> size; shares by weight under a cap, by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    total, done = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in done]
        left = total - sum(done.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return done | share
        done |= {s: 3.0 * sizes[s] for s in over}


def mix_key(doc_id, weight, seed=11):
    h = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
    if doc_id is not None:
        h = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), h)
    return -math.log(((h >> 11) + 0.5) / float(1 << 53)) / weight


def mix(rows, weights):
    """Copies of each (doc_id, source, size) row; each source's bins hold all its rows."""
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    goal, copies = targets(sizes), {}
    for s in sizes:
        own = sorted((mix_key(d, weights.get(d, 1.0)), d, n) for d, x, n in rows if x == s)
        epochs = math.floor(goal[s] / sizes[s]) if sizes[s] else 0
        gap, picked = goal[s] - epochs * sizes[s], set()
        whole = sizes[s] <= gap
        for _ in range(3):
            run = 0
            room = gap
            for _, d, n in own:
                if d not in picked and n <= room:
                    run += n
                    if run <= room:
                        picked.add(d)
                        gap -= n
        for _, d, n in own:
            copies[d] = epochs + (1 if whole or (d in picked and goal[s] - epochs * sizes[s] > 0) else 0)
    return copies, goal


def repeated_bytes(rows, width=50):
    """doc_id -> (n_bytes, n_removed, n_spans, sha256 of the rest)."""
    first, out = {}, {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first.setdefault(b[i : i + width], d) < d:
                gone[i : i + width] = b"\1" * width
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        rest = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out


def token_digest(texts, tokenizer, end_id=1):
    """(start, n_tokens, crc32) of texts in their order."""
    out, start = [], 0
    for t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, end_id]
        out.append((start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out
