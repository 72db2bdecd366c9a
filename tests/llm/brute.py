"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def base_scores(rows):
    """op1's counts and base score by (doc_id, text) rows."""
    tokens = [[*words((t or "").translate(LOWER)), None] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for ts, h in zip(tokens, held) if not h for w in ts)
    n, v = sum(c.values()), len(c)
    return [(h, len(ts), sum(c[w] > 0 for w in ts), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ts)) for ts, h in zip(tokens, held)]


def warc(rows):
    last = {}
    for i, h in rows:
        b = (h or "").encode()
        last[b] = max((x for x in (last.get(b), i) if x is not None), default=None)
    out = []
    for i, h in rows:
        b = (h or "").encode()
        revisit = last[b] != i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", last[b] if revisit else None))
    return out


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    w, seen, dups = words(text), set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    hit = [False] * len(w)
    for k in range(len(w) - 7):
        if c[tuple(w[k : k + 8])] > 1:
            hit[k : k + 8] = [True] * 8
    n = sum(hit)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, n, len(w) < 20 or 100 * n > 30 * len(w)


def shingles(text, size):
    w = words((text or "").translate(LOWER))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def components(rows, size=4, percent=85):
    """(n_shingles, component) for (doc_id, text) rows, comparing all pairs."""
    sets = [shingles(t, size) for _, t in rows]
    group = list(range(len(rows)))

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    group[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    return [(len(sets[k]), min((i for i in least[find(k)] if i is not None), default=None)) for k in range(len(rows))]


ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(text, items, size=13):
    """n_words, n_hit, items, contaminated."""
    w = ALNUM.findall((text or "").translate(LOWER))
    hit, found = [False] * len(w), set()
    for i, t in items:
        iw = ALNUM.findall((t or "").translate(LOWER))
        for k in range(max(1, len(iw) - size + 1) if iw else 0):
            x = iw[k : k + size]
            for p in range(len(w) - len(x) + 1):
                if w[p : p + len(x)] == x:
                    hit[p : p + len(x)] = [True] * len(x)
                    found.add(i)
    n = sum(hit)
    return len(w), n, sorted(str(i) for i in found if i is not None), n > 0 and 20 * n >= len(w)


def repeats(texts, window=35):
    """(n_words, kept words) of each text."""
    every = [words(t) for t in texts]
    c = Counter(tuple(w[k : k + window]) for w in every for k in range(len(w) - window + 1))
    out = []
    for w in every:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if c[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((len(w), [x for x, g in zip(w, gone) if not g]))
    return out


def cut(text, window, every):
    """Each removed word goes with the white space behind it."""
    if text is None:
        return None
    own = words(text)
    gone = [False] * len(own)
    for k in range(len(own) - window + 1):
        if every[tuple(own[k : k + window])] > 1:
            gone[k : k + window] = [True] * window
    lead = re.match(r"[\x20\x09-\x0D]*", text)[0]
    pieces = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)
    return lead + "".join(p for p, g in zip(pieces, gone) if not g)


def mixture(rows, weights=(3, 1, 2), share=1.5, repeats_=2, seed="mix"):
    """{(doc_id, source, size): (source_size, target, taken)} for (doc_id, source, text) rows."""
    docs = [(i, s, len(words(t)), hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()) for i, s, t in rows]
    size = Counter()
    for _, s, n, _ in docs:
        size[s] += n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, free, left = {}, set(order), share * sum(size.values())
    while free:  # reshare what is over until nothing is
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > repeats_ * size[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            target[s] = repeats_ * size[s]
            left -= target[s]
        free -= over
    copies = []
    for s in order:
        upto = 0
        for i, _, n, key in sorted((d for d in docs if d[1] == s), key=lambda d: (d[3], d[0] is not None, d[0] or 0, d[2])):
            upto += n
            copies += [((upto + k * size[s]) / target[s] if target[s] else 0.0, order.index(s), key, "" if i is None else str(i), n, k, i, s) for k in range(repeats_)]
    taken, run = Counter(), 0
    for c in sorted(copies, key=lambda c: c[:6]):
        run += c[4]
        if run > share * sum(size.values()):
            break
        taken[c[6], c[7], c[4]] += c[4]
    return {(i, s, n): (size[s], target[s], taken[i, s, n]) for i, s, n, _ in docs}


FLOOR = (0.10, 0.10, 0.05, 0.01, 0.03)


def statistics(text):
    """The five transformed statistics of a text, in units of 1/1024."""
    t, w = text or "", words(text)
    n, chars = len(w), sum(map(len, w))
    marks, capitals = len(re.findall(r"[#*$%&|<>!]", t)), len(re.findall("[A-ZÀ-Þ]", t))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    raw = ((chars + 250) / (n + 50), math.sqrt(marks / (n + 50)), (len(lines) - len(set(lines))) / (len(lines) + 5), math.log(len(set(w)) + 50) / math.log(n + 50), math.sqrt(capitals / (chars + 250)))
    return [math.floor(x * 1024 + 0.5) for x in raw]


def outliers(rows, share=0.75, quantile_cut=25.7, factor=1.4121, min_rows=200):
    """Squared distances of (lang, source, text) rows: least determinant of many random starts in each group."""
    import numpy as np

    rng = np.random.default_rng(3)
    stats = np.array([statistics(t) for _, _, t in rows], float) / 1024
    size = Counter((a, b) for a, b, _ in rows)
    pooled = Counter()
    for (a, _), n in size.items():
        pooled[a] += n * (n < min_rows)
    group = [(0, a, b) if size[a, b] >= min_rows else (1, a, None) if pooled[a] >= min_rows else (2, None, None) for a, b, _ in rows]
    out = np.zeros(len(rows))
    for g in set(group):
        at = np.array([i for i, x in enumerate(group) if x == g])
        x = stats[at]
        if len(x) < 16:
            continue

        def distance(mean, cov):
            d = x - mean
            return np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)

        def model(part):
            return part.mean(axis=0), np.cov(part.T, bias=True) * factor + np.diag(np.square(FLOOR))

        best = None
        for _ in range(12):
            mean, cov = model(x[rng.choice(len(x), min(len(x), 40), replace=False)])
            last = np.inf
            while True:
                bins = np.floor(np.log(distance(mean, cov) + 1e-6) * 32)
                edge = np.sort(bins)[math.ceil(share * len(x)) - 1]
                new = model(x[bins <= edge])
                det = np.linalg.slogdet(new[1])[1]
                if det >= last - 1e-9:
                    break
                last, (mean, cov) = det, new
            if best is None or last < best[0]:
                best = last, mean, cov
        out[at] = distance(*best[1:])
    return out


TRIE_COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def reopened(rows):
    """op12's rebuilt conversations by (conv_id, turn, role, text) rows."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    out = {}
    for c, ts in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - c % 100, [])[:h] + ts[h:]
    return out


def trie(convs):
    """Rows of TRIE_COLUMNS for a dict of turn lists."""
    members, chars = defaultdict(list), {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
            chars[tuple(ts[:d])] = len(ts[d - 1][1]) if d else 0
    children, below = Counter(n[:-1] for n in members if n), defaultdict(lambda: [0, 0])
    for n, cs in members.items():
        for d in range(len(n) + 1):
            below[n[:d]][0] += not children[n]
            below[n[:d]][1] += (len(cs) - 1) * chars[n]
    out = []
    for n, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(convs[c]) == len(n))
        out.append((min(cs), len(n), min(members[n[:-1]]) if n else None, len(cs), children[n], *below[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def runs(ws, least=24, times=3):
    """(start, length, period) of all maximal runs, each lag and place looked at."""
    found = {}
    for q in range(1, len(ws) // times + 1):
        i = 0
        while i + q < len(ws):
            j = i
            while j + q < len(ws) and ws[j] == ws[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(ws, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


def planted(doc_id, ws):
    if doc_id is None:
        return ws
    h, n = zlib.crc32(str(doc_id).encode()), len(ws)
    if h % 10 or not n:
        return ws
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]


def periodic(doc_id, text):
    ws = planted(doc_id, words(text))
    found = runs(ws)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(lines), sha(collapsed(ws, found)))


def site_trees(rows, threshold=0.2, doubted=0.7, weight=0.9, min_pages=4):
    """Texts that the style trees leave of (id, host, html) rows whose pages mark no article."""
    from factorloom.llm.html_text import Page

    parsed = [(i, host, Page(html)) for i, host, html in rows]
    out = {}
    for host in {h for _, h, _ in parsed}:
        mine = [(i, p) for i, h, p in parsed if h == host]
        different = {(tuple(p.nodes), tuple(map(frozenset, p.shows)), tuple(p.blocks)): p for _, p in mine}.values()
        pages, styles, texts, above, weak = Counter(), defaultdict(Counter), defaultdict(Counter), {}, {}
        for p in different:
            for (n, up, _, doubt), shown in zip(p.nodes, p.shows):
                pages[n] += 1
                styles[n][frozenset(shown)] += 1
                above[n] = p.nodes[up][0] if up >= 0 else None
                weak[n] = weak.get(n, False) or doubt
            for n, t in {(p.nodes[k][0], t) for k, t in p.blocks}:
                texts[n][t] += 1
        inside = defaultdict(list)
        for n in pages:
            top = n
            while top is not None:
                inside[top].append(n)
                top = above[top]
        importance = {}
        for n, m in pages.items():
            scale = math.log(max(m, 2))
            below = [c for x in inside[n] for c in texts[x].values()]
            differs = 1 - sum(map(math.log, below)) / len(below) / scale if below else 0.0
            varies = (math.log(m) - sum(c * math.log(c) for c in styles[n].values()) / m) / scale
            importance[n] = weight * differs + (1 - weight) * varies if m >= min_pages else 1.0
        low = {n for n in pages if max(importance[x] for x in inside[n]) < (doubted if weak[n] else threshold)}
        for i, p in mine:
            gone = []
            for n, up, _, _ in p.nodes:
                gone.append(n in low or up >= 0 and gone[up])
            out[i] = " ".join(t for k, t in p.blocks if not gone[k])
    return out


END, START = "</end>", "<start>"


class Interpolated:
    """Deleted interpolation over (text, role) rows, role 1: counts, 2: counts and held out for the weights, 0: neither."""

    def __init__(self, rows, order, learn):
        from factorloom.llm.deleted_interpolation import BUCKETS, GRID, PER_DECADE

        self.order = order
        texts = [(self.tokens(t), r) for t, r in rows]
        every = [Counter(g for ts, r in texts if r for g in self.grams(ts, k)) for k in range(order)]
        held = [Counter(g for ts, r in texts if r == 2 for g in self.grams(ts, k)) for k in range(order)]
        rest = [c - d for c, d in zip(every, held)]
        sizes = sum(r > 0 for _, r in texts), sum(r == 1 for _, r in texts)
        hist = Counter()
        self.counts, self.texts = rest, sizes[1]
        for ts, r in texts:
            if r == 2:
                for i in range(len(ts)):
                    seen = [self.seen(ts, i, k) for k in range(order)]
                    step = [min(GRID - 2, math.floor(-math.log10(a / b) * PER_DECADE)) if a and b else GRID - 1 for a, b in seen]
                    hist[(*(self.bucket(b, BUCKETS) for _, b in seen), *step)] += 1
        self.weights = learn([(*k, n) for k, n in sorted(hist.items())], order, 1 / (len(rest[0]) + 1))
        self.counts, self.texts, self.buckets = every, sizes[0], BUCKETS

    @staticmethod
    def tokens(text):
        return [*words((text or "").translate(LOWER)), END]

    @staticmethod
    def bucket(n, most):
        return min(most - 1, int(math.floor(math.log2(n))) + 1) if n else 0

    @staticmethod
    def grams(ts, k):
        padded = [START] * k + ts
        return [tuple(padded[i : i + k + 1]) for i in range(len(ts))]

    def seen(self, ts, i, k):
        """Count of the k + 1 tokens up to ``i``, and of their context."""
        gram = tuple(([START] * k + ts)[i : i + k + 1])
        context = sum(self.counts[0].values()) if k == 0 else self.texts if i == 0 else self.counts[k - 1][gram[:-1]]
        return self.counts[k][gram], context

    def probability(self, ts, i):
        p = 1 / (len(self.counts[0]) + 1)
        for k in range(self.order):
            a, b = self.seen(ts, i, k)
            w = self.weights[k][self.bucket(b, self.buckets)] if b else 0.0
            p = w * (a / b if b else 0.0) + (1 - w) * p
        return p

    def score(self, text):
        ts = self.tokens(text)
        return sum(math.log10(self.probability(ts, i)) for i in range(len(ts)))
