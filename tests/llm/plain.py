"""Plain versions of the corpus operators over lists of (id, text): slow, and written from the definitions."""

from __future__ import annotations

import math
import re
import string
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WHITE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return WORD.findall(text or "")


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def common_lines(rows, min_docs=10):
    key = lambda line: line.strip(WHITE).translate(LOWER)
    lines = [(text or "").split("\n") for _, text in rows]
    seen = Counter(k for ls in lines for k in {key(x) for x in ls} if k)
    out = []
    for (doc_id, _), ls in zip(rows, lines):
        kept = [x for x in ls if seen[key(x)] < min_docs]
        out.append((doc_id, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


def repeated(rows, window=35):
    texts = [words(t) for _, t in rows]
    seen = Counter(tuple(ws[i : i + window]) for ws in texts for i in range(len(ws) - window + 1))
    out = []
    for (doc_id, _), ws in zip(rows, texts):
        gone = set()
        for i in range(len(ws) - window + 1):
            if seen[tuple(ws[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((doc_id, len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return out


def fingerprint(text, n=3):
    ws = words((text or "").translate(LOWER))
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_classes(rows, most=3):
    prints = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                root[top(i)] = top(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[top(i)].append(i)
    least = {g: min((rows[i][0] for i in m if rows[i][0] is not None), default=None) for g, m in groups.items()}
    return [(rows[i][0], f"{prints[i]:016x}", least[top(i)]) for i in range(len(rows))], [top(i) for i in range(len(rows))]


def measures(text):
    text, ws = text or "", words(text)
    lines = [x for x in text.split("\n") if words(x)]
    grams = Counter(zip(ws, ws[1:], ws[2:]))
    hit = {j for i, g in enumerate(zip(ws, ws[1:], ws[2:])) if grams[g] > 1 for j in (i, i + 1, i + 2)}
    n = len(ws)
    return {
        "n_words": n,
        "word_chars": sum(map(len, ws)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(hit),
        "base_failed": n < 50 or 100 * len(hit) > 50 * n,
    }


def ids_crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def hard_negatives(rows, is_anchor, positives=5, negatives=3, floor=50, ceiling=95):
    held = {i: (label, [math.floor(256 * x) for x in v]) for i, v, label in rows}
    out = []
    for a in sorted(held):
        if not is_anchor(a):
            continue
        label, mine = held[a]
        score = {i: sum(x * y for x, y in zip(mine, v)) for i, (_, v) in held.items() if i != a and len(v) == len(mine)}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if held[i][0] == label][:positives]:
            inside = [i for i in order if held[i][0] != label and floor * score[p] <= 100 * score[i] <= ceiling * score[p]]
            out += [(a, p, k + 1, n, score[p], score[n]) for k, n in enumerate(inside[:negatives])]
    return sorted(out)


def overlaps(a_sizes, b_sizes):
    ranges = lambda sizes: [(sum(sizes[:i]), sum(sizes[: i + 1])) for i in range(len(sizes))]
    return {(i, k) for i, (s, e) in enumerate(ranges(a_sizes)) for k, (t, f) in enumerate(ranges(b_sizes)) if max(s, t) < min(e, f)}


def aligned(texts, a_coder, b_coder):
    letters = {c: b for b, c in byte_letters().items()}
    a_bytes = lambda i: bytes(letters[c] for c in a_coder.id_to_token(i)) if i != 50256 else b"<|endoftext|>"

    def b_bytes(i):
        piece = b_coder.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_coder.is_byte(i) else piece.replace("▁", " ").encode()

    found = []
    for text in texts:
        a = a_coder.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_coder.encode(text or "")
        a_parts, b_parts, whole = [a_bytes(i) for i in a], [b_bytes(i) for i in b], b" " + (text or "").encode()
        if not text or b"".join(a_parts) != whole or b"".join(b_parts) != whole:
            found.append(([], [], [], []))
            continue
        groups, links, i, k, at, bt, g = [], [], 0, 0, 0, 0, ([], [])
        while i < len(a):  # both lists side by side; the one that is behind goes on
            links.append((a[i], b[k]))
            a_end, b_end = at + len(a_parts[i]), bt + len(b_parts[k])
            if a_end <= b_end:
                g[0].append(a[i])
            if b_end <= a_end:
                g[1].append(b[k])
            if a_end == b_end:
                groups.append(g)
                g = ([], [])
            if a_end <= b_end:
                i, at = i + 1, a_end
            if b_end <= a_end:
                k, bt = k + 1, b_end
        found.append((a, b, groups, links))
    count = Counter(x for f in found for x in f[3])
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [
        {
            "n_a": len(a),
            "n_b": len(b),
            "n_groups": len(groups),
            "n_links": len(links),
            "n_best": sum(count[x] == best[x[1]] for x in links),
            "count_sum": sum(count[x] for x in links),
            "groups": ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups),
        }
        for a, b, groups, links in found
    ]


def byte_letters():
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


def grams(text, letters, longest):
    """Grams that hold a letter; other letters than `letters` are one kind, a run of anything else is a blank."""
    signs = "".join(" " if not c.isalpha() else c.lower()[0] if c.lower()[0] in letters else "\1" for c in text)
    signs = " " + " ".join(signs.split(" ")) + " "
    signs = re.sub(" +", " ", signs)
    return {signs[i : i + n] for n in range(1, longest + 1) for i in range(len(signs) - n + 1)} - {" "}


def shared_grams(a, b):
    return len(a & b) / math.sqrt(max(1, len(a)) * max(1, len(b)))


def ridge(near, names, languages, between, penalty, asked):
    """Kernel ridge regression in the landmarks' space, every language weighing the same, by the dual of the features."""
    weights, directions = np.linalg.eigh(between)
    kept = weights > 1e-6 * weights.max()
    root = directions[:, kept] @ np.diag(weights[kept] ** -0.5)
    f = np.hstack([near @ root, np.ones((len(near), 1))])
    n = Counter(names)
    share = np.array([1 / n[x] / len(n) for x in names])
    gram = f @ f.T
    out = []
    for lang in languages:
        y = np.array([1.0 if x == lang else -1.0 for x in names])
        out.append(np.hstack([asked @ root, np.ones((len(asked), 1))]) @ f.T @ np.linalg.solve(gram + penalty * np.diag(1 / share), y))
    return np.array(out).T


def toxicity_features(text):
    """The classifier's features of one text, word by word."""
    from basketry.llm import toxicity
    from basketry.llm.common import Words

    def code(part):
        return int(Words([part]).hashes()[0])

    seen = Counter()
    for word in re.findall(rb"[^\x20\x09-\x0D]+", text.lower().encode()):
        word = word.strip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
        if word:
            seen[code(word) % toxicity.BUCKETS] += 1
        for n in toxicity.STEMS:
            if len(word) > n:
                seen[((code(word[:n]) >> 2 * n) ^ n * 0x9E37) % toxicity.BUCKETS] += 1
    return {b + level * toxicity.BUCKETS for b, n in seen.items() for level in range(toxicity.LEVELS) if n > level}
