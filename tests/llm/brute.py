"""Plain Python versions of the operators, one row at a time."""

import hashlib
import math
import re
import string
from collections import Counter, defaultdict

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (text or "").translate(FOLD))


def shingles(text, n):
    w = words(text)
    if len(w) >= n:
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    return {tuple(w)} if w else set()


def groups(docs, n, percent):
    """(n_shingles, component) by position; every pair is compared."""
    sets = [shingles(t, n) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * either:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return [(len(s), least.get(root(i)) if s else docs[i][0]) for i, s in enumerate(sets)]


def contamination(text, items, window=13):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w = words(text, pattern)
    hit, found = set(), set()
    for item_id, item in items:
        v = words(item, pattern)
        n = min(window, len(v))
        if not n:
            continue
        wanted = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in wanted:
                hit.update(range(i, i + n))
                if item_id is not None:
                    found.add(str(item_id))
    return len(w), len(hit), sorted(found)


class Trie:
    """Prediction by partial matching, method C with exclusion, one symbol at a time."""

    def __init__(self, texts, order):
        self.order, self.counts = order, defaultdict(Counter)
        for text in texts:
            for context, symbol in self.symbols(text):
                for k in range(order + 1):
                    self.counts[context[order - k :]][symbol] += 1

    def symbols(self, text):
        data = b"\xff" * self.order + (text or "").translate(FOLD).encode() + b"\xff"
        for i in range(self.order, len(data)):
            yield data[i - self.order : i], data[i]

    def log10(self, text):
        total = 0.0
        for context, symbol in self.symbols(text):
            excluded = set()
            for k in range(self.order, -1, -1):
                counts = {s: n for s, n in self.counts[context[self.order - k :]].items() if s not in excluded}
                if not counts:
                    continue
                whole = sum(counts.values()) + len(counts)
                if symbol in counts:
                    total += math.log10(counts[symbol] / whole)
                    break
                total += math.log10(len(counts) / whole)
                excluded |= counts.keys()
            else:
                total -= math.log10(256 - len(excluded))
        return total


def alignments(docs, encode_a, bytes_a, encode_b, bytes_b):
    """Rows of the alignment by position; tokens are compared pair by pair."""
    found = []
    for _, text in docs:
        whole = (" " + (text or "")).encode()
        a, b = (encode_a(" " + text), encode_b(text)) if text else ([], [])
        if b"".join(bytes_a[i] for i in a) != whole or b"".join(bytes_b[i] for i in b) != whole:
            a, b = [], []
        spans = []
        for ids, of in ((a, bytes_a), (b, bytes_b)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(of[i]), i))
                at += len(of[i])
            spans.append(out)
        links = Counter((i, j) for x, y, i in spans[0] for u, v, j in spans[1] if x < v and u < y)
        cuts = sorted({y for _, y, _ in spans[0]} & {y for _, y, _ in spans[1]})
        written = [
            "|".join(",".join(str(i) for x, y, i in side if low <= x and y <= high) for side in spans)
            for low, high in zip([0, *cuts], cuts)
        ]
        found.append((len(a), len(b), len(cuts), links, ";".join(written)))
    counts = Counter(pair for row in found for pair in row[3])
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    out = []
    for n_a, n_b, n_groups, links, written in found:
        n_best = sum(n for p, n in links.items() if counts[p] == best[p[0]])
        total = sum(n * counts[p] for p, n in links.items())
        digest = hashlib.sha256(written.encode()).hexdigest() if n_a else ""
        out.append((n_a, n_b, n_groups, sum(links.values()), n_best, total, digest))
    return out, counts


def phrases(docs, least, longest, top, holds):
    """(lang, rank, phrase, a, l, r, n, score) with every phrase counted."""
    out = []
    for lang in {lang or "und" for _, lang in docs}:
        f, n = Counter(), 0
        for text, of in docs:
            if (of or "und") != lang:
                continue
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
                w = re.findall(r"[^\x20\x09]+", piece)
                n += len(w)
                for k in range(1, longest + 1):
                    f.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        some = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        held = set()
        for p, a in some.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    if 100 * a >= holds * f[p[i : i + k]]:
                        held.add(p[i : i + k])
        rows = []
        for p, a in some.items():
            score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if p not in held:
                rows.append((-score, -a, " ".join(p).encode(), a, l, r, score))
        for rank, (_, _, p, a, l, r, score) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), a, l, r, n, score))
    return sorted(out)


def statistics(text):
    """Some of a text's statistics, from Python strings."""
    data = (text or "").encode()
    w = [x.translate(FOLD) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    most = max(Counter(w).values(), default=0)
    pairs = list(zip(w, w[1:]))
    lines = re.findall(r"[^\x0A-\x0D]+", (text or "").translate(FOLD))
    twice = sum(len(x.encode()) for x in lines if lines.count(x) > 1)
    return {
        "bytes": math.log1p(len(data)),
        "share upper": sum(0x41 <= b <= 0x5A for b in data) / max(len(data), 1),
        "words": math.log1p(len(w)),
        "word length": sum(len(x.encode()) for x in w) / max(len(w), 1),
        "distinct words": len(set(w)) / max(len(w), 1),
        "commonest word": most / max(len(w), 1),
        "word after itself": sum(x == y for x, y in pairs) / max(len(w), 1),
        "distinct pairs": len(set(pairs)) / max(len(pairs), 1),
        "distinct lines": len(set(lines)) / max(len(lines), 1),
        "bytes in repeated lines": twice / max(sum(len(x.encode()) for x in lines), 1),
    }
