"""Quality classification by co-training a text-content view and a page-metadata view.

Two faults are learned, low quality and toxicity. For each, the text view sees the shape of a text (kinds of characters,
repetition, lengths) and the presence of words and word beginnings that Spark's counts over labelled documents found
telling (by the likelihood ratio of their presence); the metadata view sees source, language and length.

Every document's numbers are made once and written to the shared folder as a row of some 150 bytes. In each round both
views judge all unlabelled documents, and those of which a view is surer than SURE become examples of the other view. All
confident documents of the table are counted and stand for choice; of each kind, PER_ROUND times the number of the round
at most, those of the smallest key hashes, are put into the other view's fit. Words are counted in COUNTED labelled
documents and the fits take LABELLED of them, at most, chosen in the same way: so no text is moved to meet its label. Both views are calibrated on labelled documents by cross-fitting: each document is judged by a fit that left its
fold out, and one line through those logits, its slope held positive, gives probabilities. The views' evidence is then
added to score every document whole.

A document is rejected from LOW_FROM or TOXIC_FROM, or from a higher probability where that is needed to keep the share of
rejected clean documents, judged by the same cross-fitting, within FALSE_ALARMS.

Defined cases: a null text is empty; labels of absent documents and null labels are not used; a fault with fewer than LEAST
documents of either kind (no labels, one kind only, a handful) isn't learned and is never found, its probability is 0;
rows that share a key are each an example with its label, and each is scored; a null key is unlabelled; null or unknown
sources and languages count as empty; tables without ``source`` or ``lang`` are read as if these were null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm import textkernels as K
from terrace.llm.shared import dropped, extended, written

#: Labelled documents whose words are counted and that the models are fitted on, at most; the telling words they look for.
COUNTED, LABELLED, WORDS = 50_000, 6000, 512
#: Labelled documents that a telling word is in at least, and lengths of the word beginnings that are looked at.
LEAST_DOCS, BEGINNINGS = 4, (4, 5, 6, 7)
#: Probabilities from which a document counts as of low quality and as toxic, and clean documents that may be rejected for each.
LOW_FROM, TOXIC_FROM, FALSE_ALARMS = 0.5, 0.2, 0.01
#: Rounds of fitting, with an exchange after each but the last, and what is exchanged.
ROUNDS, PER_ROUND, SURE = 3, 400, 0.97
#: Folds of the calibration, labelled documents of each kind that it takes to learn a fault, and the least slope.
FOLDS, LEAST, LEAST_SLOPE = 5, 8, 1e-3
FAULTS, VIEWS = ("low", "toxic"), ("text", "page")
_U = np.uint64
_KINDS = 11  # lower, upper, digit, space, newline, full stop or comma, bar, exclamation mark, marker, other sign, non-ASCII


def _kind_table() -> np.ndarray:
    t = np.full(256, 9, np.uint8)
    t[97:123], t[65:91], t[48:58], t[128:] = 0, 1, 2, 10
    t[[9, 11, 12, 13, 32]] = 3
    t[10] = 4
    t[[44, 46]] = 5
    t[124], t[33] = 6, 7
    t[[ord(c) for c in "#$%&*+<=>@^_`~\\"]] = 8
    return t


_KIND = _kind_table()
_APART = np.isin(_KIND, (3, 4, 5, 6, 7, 8, 9))
_LINE = np.zeros(256, bool)
_LINE[10] = True


def shapes(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of shape numbers for each text."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(n), sizes)
    kinds = np.bincount(row * _KINDS + _KIND[buf], minlength=n * _KINDS).reshape(n, _KINDS)
    starts, ends, at = K.word_spans(buf, offsets)
    words = np.diff(at)
    many = np.maximum(words, 1)
    h = K.span_hashes(K.LOWER[buf], starts, ends)
    owner = np.repeat(np.arange(n), words)
    _, first, count = np.unique(h ^ K.mix(owner.astype(_U) + _U(1)), return_index=True, return_counts=True)
    distinct, most = np.bincount(owner[first], minlength=n), np.zeros(n, np.int64)
    np.maximum.at(most, owner[first], count)
    marked = np.concatenate([[0], np.cumsum(np.isin(_KIND[buf], (6, 7, 8)))])
    with_mark = np.bincount(owner, weights=marked[ends] > marked[starts], minlength=n)
    ls, le, lat = K.word_spans(buf, offsets, _LINE)
    lines = np.maximum(np.diff(lat), 1)
    lowner = np.repeat(np.arange(n), np.diff(lat))
    lfirst = np.unique(K.span_hashes(buf, ls, le) ^ K.mix(lowner.astype(_U) + _U(1)), return_index=True)[1]
    size = np.maximum(sizes, 1)
    letters = np.maximum(kinds[:, 0] + kinds[:, 1], 1)
    return np.column_stack(
        [np.log1p(words), (sizes - kinds[:, 3] - kinds[:, 4]) / many, with_mark / many, kinds[:, 1] / letters, kinds[:, 2] / size, kinds[:, 5] / many, kinds[:, 6] / many, kinds[:, 7] / many, kinds[:, 8] / size, kinds[:, 9] / size, kinds[:, 10] / size, distinct / many, most / many, np.bincount(lowner[lfirst], minlength=n) / lines, words / lines]
    ).astype(np.float32)


def lexical(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every word and of its beginnings, words being runs of letters and digits."""
    starts, ends, at = K.word_spans(buf, offsets, _APART)
    low, owner = K.LOWER[buf], np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    out_row, out = [owner], [K.span_hashes(low, starts, ends)]
    for size in BEGINNINGS:
        longer = ends - starts > size
        out_row.append(owner[longer])
        out.append(K.mix(K.span_hashes(low, starts[longer], starts[longer] + size) + _U(size)))
    return np.concatenate(out_row), np.concatenate(out)


def present(row: np.ndarray, h: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, place in the sorted vocabulary) of the hashes that it has."""
    if not len(vocabulary):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    spot = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    hit = vocabulary[spot] == h
    both = np.unique(row[hit] * len(vocabulary) + spot[hit])
    return both // len(vocabulary), both % len(vocabulary)


def page_numbers(source: pa.Array, lang: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """Hash bucket of the source, of the language, and logarithm of the length."""

    def bucket(column: pa.Array, n: int) -> np.ndarray:
        buf, offsets = K.buffers(column.cast(pa.string()))
        return (K.span_hashes(buf, offsets[:-1], offsets[1:]) % _U(n)).astype(np.float32) if len(buf) else np.zeros(len(column), np.float32)

    return np.column_stack([bucket(source, 64), bucket(lang, 16), np.log1p(sizes).astype(np.float32)])


@dataclass
class Logistic:
    """Ridge-penalised logistic regression on intervals of numbers and on marks, and the line that calibrates it."""

    edges: list[np.ndarray]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: float = 1.0
    shift: float = 0.0

    def expand(self, numbers: np.ndarray, marks: np.ndarray) -> np.ndarray:
        columns = [np.ones((len(numbers), 1), np.float32)]
        for k, e in enumerate(self.edges):
            columns.append((np.searchsorted(e, numbers[:, k], "right")[:, None] == np.arange(len(e) + 1)).astype(np.float32))
        return np.concatenate([*columns, marks.astype(np.float32)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.scale * self.raw(x) + self.shift


def probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30)))


def fitted(x: np.ndarray, y: np.ndarray, uses: np.ndarray, start: np.ndarray | None = None, ridge: float = 0.05) -> np.ndarray:
    """Weights of one fit for each column of ``uses``, which tells the rows it takes: accelerated gradient steps, with the step size of each column's own curvature bound, fewer from a near start."""
    steps = 250 if start is None else 100
    w = seen = np.zeros((x.shape[1], uses.shape[1]), np.float32) if start is None else start
    rate = (1.0 / (0.25 * x.sum(1).max() * np.maximum(x.T @ uses, 1) + ridge)).astype(np.float32)
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ seen, -30, 30)))
        new = seen - rate * (x.T @ ((p - y[:, None]) * uses) + np.float32(ridge) * seen)
        seen, w = new + np.float32(k / (k + 3)) * (new - w), new
    return w


def line(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of Platt's line through logits, for softened labels: Newton's method on a convex loss, each step halved until the loss falls.

    Logits are brought to unit spread first, and a slope below LEAST_SLOPE is held there, so that a view that knows nothing
    gives the share of the fault and nothing else.
    """
    z, spread = z.astype(float), max(float(np.std(z)), 1e-6)
    up, down = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    u = z / spread
    loss = lambda a, b: float(np.logaddexp(0, a * u + b).sum() - (t * (a * u + b)).sum() + 1e-3 * a * a)

    def least(a: float, b: float, free: bool) -> tuple[float, float]:
        for _ in range(50):
            p = probability(a * u + b)
            v, g = p * (1 - p), p - t
            gradient = np.array([(g * u).sum() + 2e-3 * a, g.sum()])
            h = np.array([[(v * u * u).sum() + 2e-3, (v * u).sum()], [(v * u).sum(), v.sum() + 1e-9]])
            step = np.linalg.solve(h, gradient) if free else np.array([0.0, gradient[1] / h[1, 1]])
            size = 1.0
            while size > 1e-6 and loss(a - size * step[0], b - size * step[1]) > loss(a, b):
                size /= 2
            a, b = a - size * step[0], b - size * step[1]
            if np.abs(size * step).max() < 1e-9:
                break
        return float(a), float(b)

    a, b = least(0.0, float(np.log(t.mean() / (1 - t.mean()))), True)
    if a < LEAST_SLOPE:
        a, b = least(LEAST_SLOPE, b, False)
    return a / spread, b


@dataclass
class Fault:
    """Both calibrated views of a fault, its share's logit, and the probability from which documents are rejected."""

    text: Logistic
    page: Logistic
    prior: float
    least: float

    def logits(self, numbers: np.ndarray, marks: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.text.logit(self.text.expand(numbers, marks)), self.page.logit(self.page.expand(page, np.empty((len(page), 0))))

    def probability(self, numbers: np.ndarray, marks: np.ndarray, page: np.ndarray) -> np.ndarray:
        return probability(sum(self.logits(numbers, marks, page)) - self.prior)


@dataclass
class Model:
    """The telling words' hashes, what was learned of each fault, and how many confident judgements there were and were taken in each exchange."""

    vocabulary: np.ndarray
    faults: dict[str, Fault]
    exchanged: list[dict] = field(default_factory=list)

    def probabilities(self, numbers: np.ndarray, marks: np.ndarray, page: np.ndarray) -> dict[str, np.ndarray]:
        return {f: self.faults[f].probability(numbers, marks, page) if f in self.faults else np.zeros(len(numbers)) for f in FAULTS}

    def good(self, p: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(p[FAULTS[0]]), bool)
        for f, x in self.faults.items():
            out &= p[f] < x.least
        return out


def _edges(numbers: np.ndarray, parts: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, parts + 1)[1:-1])).astype(np.float32) for c in numbers.T]


@dataclass
class Examples:
    """Rows of numbers, marks and page numbers with the label of one fault."""

    numbers: np.ndarray
    marks: np.ndarray
    page: np.ndarray
    y: np.ndarray

    def __add__(self, other: Examples) -> Examples:
        return Examples(*(np.concatenate([getattr(self, n), getattr(other, n)]) for n in ("numbers", "marks", "page", "y")))


def both_views(known: Examples, given: dict[str, Examples], least: float, started: dict[str, np.ndarray]) -> Fault | None:
    """Both views of one fault, fitted on the labelled examples and on those that the other view gave, and calibrated on the labelled ones; ``started`` holds the last round's weights."""
    up = int(known.y.sum())
    if min(up, len(known.y) - up) < LEAST:
        return None
    fold = np.empty(len(known.y), np.int64)
    for label in (0, 1):  # each fold has its share of either kind
        rows = np.flatnonzero(known.y == label)
        fold[rows] = np.arange(len(rows)) % FOLDS
    prior, views, aside = float(np.log(up / (len(known.y) - up))), {}, 0.0
    for view in VIEWS:
        edges = _edges(known.numbers, 12) if view == "text" else [np.arange(0.5, 64), np.arange(0.5, 16), *_edges(known.page[:, 2:], 8)]
        model, all_ = Logistic(edges), known + given[view]
        x = model.expand(all_.numbers, all_.marks) if view == "text" else model.expand(all_.page, np.empty((len(all_.page), 0)))
        uses = np.ones((len(x), FOLDS + 1), np.float32)
        uses[np.arange(len(fold)), fold + 1] = 0
        w = started[view] = fitted(x, all_.y.astype(np.float32), uses, started.get(view))
        model.weights = w[:, 0]
        z = np.einsum("ij,ij->i", x[: len(fold)], w[:, fold + 1].T)
        model.scale, model.shift = line(z, known.y)
        views[view], aside = model, aside + model.scale * z + model.shift
    clean = np.sort(probability(aside - prior)[known.y == 0])
    bound = clean[len(clean) - 1 - int(FALSE_ALARMS * len(clean))]
    return Fault(views["text"], views["page"], prior, float(max(least, np.nextafter(bound, 2))))


def _features(batch: pa.RecordBatch, text: int, source: int, lang: int, vocabulary: np.ndarray) -> Iterator[tuple]:
    """First and last row, shape numbers, present marks and page numbers of each slice of a batch."""
    buf, offsets = K.buffers(batch.column(text))
    for a, b in K.slices(offsets):
        part, at = buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        g = page_numbers(batch.column(source).slice(a, b - a), batch.column(lang).slice(a, b - a), np.diff(at))
        marks = np.zeros((b - a, len(vocabulary)), np.float32)
        marks[present(*lexical(part, at), vocabulary)] = 1
        yield a, b, shapes(part, at), marks, g


def _own(docs: DataFrame, text: str, *keep: Column) -> DataFrame:
    """The columns ``keep``, then __text, __source and __lang."""
    columns = [F.col(n).cast("string").alias(f"__{m}") if n in docs.columns else F.lit(None).cast("string").alias(f"__{m}") for n, m in ((text, "text"), ("source", "source"), ("lang", "lang"))]
    return docs.select(*keep, *columns)


_ROW = "numbers binary, marks binary, page binary"


def featured(docs: DataFrame, vocabulary: np.ndarray, key: str, text: str) -> DataFrame:
    """Key (_id), shape numbers, bits of the present marks and page numbers of every row."""
    frame = _own(docs, text, F.col(key).alias("_id"))
    schema = extended(frame.select("_id").schema, _ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x, m, g in _features(batch, 1, 2, 3, vocabulary):
                bits = np.packbits(m > 0, axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array([r.tobytes() for r in v], pa.binary()) for v in (x, bits, g))], schema.names)

    return frame.mapInArrow(run, schema)


def _arrays(rows: pa.Table | pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shape numbers, marks and page numbers of rows of :func:`featured`."""
    body = lambda name, kind: np.frombuffer(b"".join(rows.column(name).to_pylist()), kind).reshape(len(rows), -1)
    if not len(rows):
        return np.empty((0, 15), np.float32), np.empty((0, words), np.uint8), np.empty((0, 3), np.float32)
    marks = np.unpackbits(body("marks", np.uint8), axis=1, count=words) if words else np.empty((len(rows), 0), np.uint8)
    return body("numbers", np.float32), marks, body("page", np.float32)


def telling_words(labelled: DataFrame) -> np.ndarray:
    """Sorted hashes of the words and beginnings whose presence tells most of either fault, counted over the rows (low, toxic, __text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = K.buffers(batch.column(2))
            low, toxic = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for a, b in K.slices(offsets):
                row, h = lexical(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                _, first = np.unique(h ^ K.mix(row.astype(_U) + _U(1)), return_index=True)
                row, h = row[first] + a, h[first]
                u, back = np.unique(h, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.bincount(back, minlength=len(u))), *(pa.array(np.bincount(back, weights=x[row], minlength=len(u)).astype(np.int64)) for x in (low, toxic))], ["h", "n", "low", "toxic"])

    totals = labelled.agg(F.count("*").alias("n"), F.sum("low").alias("low"), F.sum("toxic").alias("toxic")).first()
    counts = written(labelled.mapInArrow(run, "h long, n long, low long, toxic long").groupBy("h").agg(*[F.sum(c).alias(c) for c in ("n", "low", "toxic")]).filter(F.col("n") >= LEAST_DOCS), "telling")
    words: set[int] = set()
    for fault in FAULTS:
        up, all_ = totals[fault] or 0, totals["n"]
        if 0 < up < all_:

            def part(seen: Column, of: Column, share: float) -> Column:
                return F.when(seen > 0, seen * F.log(seen / (of * share))).otherwise(0.0)

            with_, without = F.col("n"), F.lit(all_) - F.col("n")
            hit = F.col(fault)
            gain = part(hit, with_, up / all_) + part(with_ - hit, with_, 1 - up / all_) + part(F.lit(up) - hit, without, up / all_) + part(without - F.lit(up) + hit, without, 1 - up / all_)
            words |= {r["h"] for r in counts.orderBy(F.round(gain, 6).desc(), "h").limit(WORDS // 2).collect()}
    dropped(counts)
    return np.array(sorted(words), np.int64).view(_U)[np.argsort(np.array(sorted(words), np.int64).view(_U))]


def _least(rows: DataFrame, most: int) -> pa.Table:
    """The rows of the ``most`` smallest key hashes."""
    return rows.orderBy(F.xxhash64("_id"), "numbers", "marks", "page").limit(most).toArrow()


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> Model:
    """Fit both faults' views; what comes to the driver are LABELLED labelled rows and ROUNDS * PER_ROUND rows of each kind and exchange at most, of a few hundred bytes each."""
    marked = labels.filter(F.col(key).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(key).alias("_id")).agg((1 - F.min("quality")).cast("int").alias("low"), F.max("toxic").cast("int").alias("toxic"))
    labelled = docs.select(F.col(key).alias("_id")).filter("_id IS NOT NULL").distinct().join(marked, "_id")
    n = labelled.count()
    if n > COUNTED:
        labelled = labelled.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 40)) < int(0.95 * COUNTED / n * (1 << 40))).limit(COUNTED)
    counted = written(labelled, "labelled")  # COUNTED short rows at most, so they may be sent to every task
    vocabulary = telling_words(_own(docs, text, F.col(key).alias("_id")).join(F.broadcast(counted), "_id").select("low", "toxic", "__text"))
    table = written(featured(docs, vocabulary, key, text).join(marked, "_id", "left"), "features")
    first = _least(table.filter("low IS NOT NULL"), LABELLED)
    arrays = _arrays(first, len(vocabulary))
    known = {f: Examples(*arrays, first.column(f).to_numpy().astype(np.int64)) for f in FAULTS}
    none = Examples(*(x[:0] for x in arrays), np.empty(0, np.int64))
    given, started = {f: dict.fromkeys(VIEWS, none) for f in FAULTS}, {f: {} for f in FAULTS}
    model = Model(vocabulary, {})
    for turn in range(rounds):
        found = {f: both_views(known[f], given[f], least, started[f]) for f, least in zip(FAULTS, (LOW_FROM, TOXIC_FROM))}
        model.faults = {f: x for f, x in found.items() if x}
        if turn == rounds - 1 or not model.faults:
            break
        told, counts = _exchange(table.filter("low IS NULL"), model, PER_ROUND * (turn + 1))
        model.exchanged.append(counts)
        given = {f: dict.fromkeys(VIEWS, none) for f in FAULTS}  # judged anew in each round, by better views
        for (f, view, label), rows in told.items():
            other = VIEWS[1 - VIEWS.index(view)]
            given[f][other] = given[f][other] + Examples(*_arrays(rows, len(vocabulary)), np.full(len(rows), label))
    dropped(table, counted)
    return model


def _exchange(pool: DataFrame, model: Model, most: int) -> tuple[dict[tuple[str, str, int], pa.Table], dict]:
    """Of all unlabelled rows, those that a view is sure of: how many, and those of the smallest key hashes, by fault, view and label."""
    kinds = [(f, v, label) for f in model.faults for v in VIEWS for label in (0, 1)]
    schema = extended(pool.select("_id", "numbers", "marks", "page").schema, "sure int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays, sure, bit = _arrays(batch, len(model.vocabulary)), np.zeros(len(batch), np.int32), 0
            for fault in model.faults.values():
                for z in fault.logits(*arrays):
                    p = probability(z)
                    for held in (p <= 1 - SURE, p >= SURE):
                        sure |= held.astype(np.int32) << bit
                        bit += 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sure)], schema.names).filter(pa.array(sure != 0))

    rows = written(pool.select("_id", "numbers", "marks", "page").mapInArrow(run, schema), "confident")
    has = lambda k: F.col("sure").bitwiseAND(1 << k) != 0
    n = rows.agg(*[F.count_if(has(k)).alias(str(k)) for k in range(len(kinds))]).first()
    told = {kind: _least(rows.filter(has(k)), most) for k, kind in enumerate(kinds) if n[k]}
    dropped(rows)
    return told, {kind: (n[k], len(told.get(kind, []))) for k, kind in enumerate(kinds)}


def judged(docs: DataFrame, model: Model, keep: list[str], text: str = "text", only_good: bool = False) -> DataFrame:
    """The columns ``keep`` with quality (probability of good quality), toxicity (its probability) and accepted; or, of the
    accepted rows only, just those columns."""
    frame = _own(docs, text, *keep)
    schema = frame.select(*keep).schema if only_good else extended(frame.select(*keep).schema, "quality double, toxicity double, accepted boolean")
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x, marks, g in _features(batch, n, n + 1, n + 2, model.vocabulary):
                p = model.probabilities(x, marks, g)
                good = pa.array(model.good(p))
                own = [batch.column(k).slice(a, b - a) for k in range(n)]
                if only_good:
                    yield pa.RecordBatch.from_arrays(own, schema.names).filter(good)
                else:
                    yield pa.RecordBatch.from_arrays([*own, pa.array(1 - p["low"]), pa.array(p["toxic"]), good], schema.names)

    return frame.mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, quality, toxicity, accepted."""
    return judged(docs, train(docs, labels, key, text), [key], text)


def accept(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are accepted, with their columns."""
    return judged(docs, train(docs, labels, key, text), docs.columns, text, only_good=True)
