"""Plain versions of the operators, over Python lists, that tests hold results against."""

import bisect
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, start=0):
    """A table of documents with these texts, over several partitions."""
    rows = [(start + i, t, "en", "web", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


def words(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def shingles(text, width=5):
    w = words(text)
    if len(w) >= width:
        return Counter(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    return Counter([tuple(w)] if w else [])


def weighted_jaccard(a, b):
    both = sum((a | b).values())
    return sum((a & b).values()) / both if both else 1.0


def near_classes(rows, similarity=0.8):
    """key -> smallest key of its component of documents that are so similar or equal."""
    root = {k: k for k, _ in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    sets = [(k, shingles(t), t or "") for k, t in rows]
    for i, (a, x, s) in enumerate(sets):
        for b, y, t in sets[i + 1 :]:
            if s == t or (x and y and weighted_jaccard(x, y) >= similarity):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k: find(k) for k in root}


def within_one(a, b):
    """Whether one word put in, left out or changed makes a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    short, long = sorted((a, b), key=len)
    return any(short == long[:i] + long[i + 1 :] for i in range(len(long)))


def edits(a, b):
    """Words put in, left out or changed between two lines."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def near_lines(a, b, least=5):
    """Whether two lines are a fifth of the longer one's words apart at most."""
    bound = max(len(a), len(b)) // least
    x, y = Counter(a), Counter(b)
    if not bound or max(sum((x - y).values()), sum((y - x).values())) > bound:
        return False
    return edits(a, b) <= bound


def kept_lines(rows):
    """key -> text without lines that an earlier line equals or is near."""
    first, pairs = {}, defaultdict(list)
    for key, text in sorted(rows):
        for n, line in enumerate((text or "").split("\n")):
            if w := tuple(words(line)):
                first.setdefault(w, (key, n))
    gone = set()
    for line in sorted(first, key=first.get):
        # near lines have two neighbouring words in common
        grams = set(zip(line, line[1:]))
        if any(near_lines(line, other) for other in {o for g in grams for o in pairs[g]}):
            gone.add(line)
        for g in grams:
            pairs[g].append(line)
    out = {}
    for key, text in rows:
        lines = (text or "").split("\n")
        keep = [line for n, line in enumerate(lines) if not (w := tuple(words(line))) or (w not in gone and first[w] == (key, n))]
        out[key] = None if text is None else "\n".join(keep)
    return out


class KneserNey:
    """Interpolated modified Kneser-Ney trigrams over dictionaries; contexts seen once have no trigram order."""

    def __init__(self, texts):
        triples, pairs, self.n = Counter(), Counter(), Counter()
        for t in texts:
            tokens = ["<s>", "<s>", *words(t), "</s>"]
            self.n.update(tokens[2:])
            pairs.update(zip(tokens[1:], tokens[2:]))
            triples.update(zip(tokens, tokens[1:], tokens[2:]))
        often = Counter()
        for (a, b, _), c in triples.items():
            often[a, b] += c
        # each order's counts: of trigrams, of words before a pair, of words before a word
        self.counts = [Counter(b for _, b in pairs), Counter((b, c) for _, b, c in triples), Counter({t: c for t, c in triples.items() if often[t[:2]] > 1})]
        self.follow = [None, defaultdict(list), defaultdict(list)]
        for (b, _), c in self.counts[1].items():
            self.follow[1][b].append(c)
        for (a, b, _), c in self.counts[2].items():
            self.follow[2][a, b].append(c)
        self.d = [self.discounts(x) for x in self.counts]
        self.total = [sum(self.counts[0].values()), sum(self.d[0][min(k, 3)] for k in self.counts[0].values())]

    @staticmethod
    def discounts(counts):
        n = [sum(c == r for c in counts.values()) for r in range(5)]
        if not n[1] or not n[2]:
            return [0.0, 0.5, 0.75, 1.0]
        y = n[1] / (n[1] + 2 * n[2])
        raw = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
        return [0.0, *(min(max(x, 0.1), k + 0.95) for k, x in enumerate(raw))]

    def share(self, order, count, counts, low):
        if not counts:
            return low
        d = self.d[order]
        return (max(count - d[min(count, 3)], 0) + sum(d[min(k, 3)] for k in counts) * low) / sum(counts)

    def p(self, a, b, c):
        one, n = 1 / (len(self.n) + 1), self.counts[0][c]
        if self.total[0]:
            one = (max(n - self.d[0][min(n, 3)], 0) + self.total[1] * one) / self.total[0]
        two = self.share(1, self.counts[1][b, c], self.follow[1].get(b, []), one)
        return self.share(2, self.counts[2][a, b, c], self.follow[2].get((a, b), []), two)

    def score(self, text, p=None):
        tokens = ["<s>", "<s>", *words(text), "</s>"]
        return sum(math.log10((p or self.p)(*x)) for x in zip(tokens, tokens[1:], tokens[2:]))

    def pairs_only(self, a, b, c):
        """The same model without its trigram order."""
        return self.p("<none>", b, c)

    def base(self, text):
        total, v = sum(self.n.values()), len(self.n)
        return sum(math.log10((self.n[t] + 0.1) / (total + 0.1 * (v + 1))) for t in [*words(text), "</s>"])


def held_out(key):
    return zlib.crc32(str(key).encode()) % 10 == 0


def padded(text):
    data = (text or "").encode()
    return data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))


def span_hash(data):
    """The 64-bit hash of a byte string by which vocabularies of words are kept."""
    whole = (1 << 64) - 1
    h = sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(data)) + len(data) * 0xC4CEB9FE1A85EC53
    return mixed(h & whole)


def mixed(x):
    whole = (1 << 64) - 1
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> 33)) * factor & whole
    return x ^ (x >> 33)


def shape_numbers(text):
    """The numbers of a text's shape, counted byte by byte."""
    data = (text or "").encode()
    size, tokens = max(len(data), 1), re.findall(rb"[^\x20\x09-\x0D]+", data.lower())
    marks = rb"|!#$%&*+<=>@^_`~\\"
    count = lambda some: sum(b in some for b in data)
    many, lines = max(len(tokens), 1), [x for x in data.split(b"\n") if x]
    lower, upper, digit = (sum(a <= b <= z for b in data) for a, z in ((97, 122), (65, 90), (48, 57)))
    blank, foreign = count(b" \t\x0b\x0c\r"), sum(b >= 128 for b in data)
    stops, bars, shouts, markers = count(b".,"), count(b"|"), count(b"!"), count(b"#$%&*+<=>@^_`~\\")
    other = len(data) - lower - upper - digit - blank - data.count(b"\n") - stops - bars - shouts - markers - foreign
    return [
        math.log1p(len(tokens)), (len(data) - blank - data.count(b"\n")) / many, sum(any(b in marks for b in w) for w in tokens) / many, upper / max(lower + upper, 1), digit / size, stops / many, bars / many, shouts / many,
        markers / size, other / size, foreign / size, len(set(tokens)) / many, max(Counter(tokens).values(), default=0) / many, len(set(lines)) / max(len(lines), 1), len(tokens) / max(len(lines), 1),
    ]


def fault_probability(fault, vocabulary, text, source, lang):
    """Probability of a fault by plain sums of a fitted model's weights."""
    data = (text or "").encode()
    held = {int(h): k for k, h in enumerate(vocabulary)}
    found = set()
    for w in re.findall(rb"[A-Za-z0-9\x80-\xff]+", data):
        w = w.lower()
        found.add(held.get(span_hash(w)))
        found |= {held.get(mixed((span_hash(w[:k]) + k) & ((1 << 64) - 1))) for k in (4, 5, 6, 7) if len(w) > k}
    bucket = lambda x, n: span_hash(x.encode()) % n if x else 0
    total = -fault.prior
    for view, numbers in ((fault.text, shape_numbers(text)), (fault.page, [bucket(source, 64), bucket(lang, 16), math.log1p(len(data))])):
        w, at = [float(x) for x in view.weights], 1
        z = w[0]
        for edges, x in zip(view.edges, numbers):
            short = struct.unpack("f", struct.pack("f", x))[0]  # numbers are kept as single floats
            z += w[at + bisect.bisect_right([float(e) for e in edges], short)]
            at += len(edges) + 1
        if view is fault.text:
            z += sum(w[at + k] for k in found if k is not None)
        total += view.scale * z + view.shift
    return 1 / (1 + math.exp(-total))
