"""Quality classifier by co-training over two views of a document.

The text view sees words (hashed, those whose frequency differs between the
labels) and measures of the text's style and line layout; the metadata view sees
only what the table says of the page: language, source and declared length. Each
view is a logistic regression, fitted on the labelled documents. In every round
each view judges all unlabelled documents of the corpus, and of those that it is
sure of by its calibrated probability a class-balanced draw goes, with its labels,
to the other view's training set. A held-out part of the labels calibrates each
view (Platt) and fits the combination of both, which then scores every document.

Two such pairs are trained: one for low quality, one for toxicity. A document is
kept if neither says so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, read, stored, text_chunks, trim, with_fields

BITS = 18
SLOTS = 1 << BITS
LANGS, SOURCES = 16, 64
SCORES = "n_words long, p_low double, p_toxic double"


def style(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Measures of each text: size, word length and variety, and shares of kinds of bytes."""
    def by(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.float64)))
        return total[at[1:]] - total[at[:-1]]

    n = np.diff(bounds).astype(np.float64)
    size = np.diff(offsets).astype(np.float64)
    some = np.maximum(n, 1)
    same = np.zeros(len(h), dtype=bool)
    if len(h) > 1:
        same[1:] = h[1:] == h[:-1]
    same[bounds[:-1][n > 0]] = False
    kinds = np.zeros((6, 256), dtype=bool)
    kinds[0, list(b"#*$%&|<>{}[]\\^~=_+@/")] = True
    kinds[1, 65:91] = True
    kinds[2, 48:58] = True
    kinds[3, list(b"!?")] = True
    kinds[4, list(b".,;:'\"()-")] = True
    kinds[5, 128:] = True
    shares = [by(k[data], offsets) / np.maximum(size, 1) for k in kinds]
    distinct = np.array([len(np.unique(h[a:b])) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], dtype=np.float64)
    length = by((end - start).astype(np.float64), bounds) / some
    heavy = by((end - start) == 1, bounds) / some
    lines = by(data == 10, offsets) + 1
    layout = [np.log1p(lines), np.log1p(size / lines)]
    return np.stack([*layout, np.log1p(n), length, distinct / some, distinct / np.sqrt(some), by(same, bounds) / some, heavy, *shares, *[np.sqrt(s) for s in shares[:4]]], axis=1)


def metadata(batch: pa.RecordBatch, first: int, count: int) -> np.ndarray:
    """Language and source as hashed indicators, of their whole values, null apart
    from empty, and the declared length."""
    out = np.zeros((count, LANGS + SOURCES + 2))
    for name, width, base in (("lang", LANGS, 0), ("source", SOURCES, LANGS)):
        coded = batch.column(name).slice(first, count).dictionary_encode()
        values = [v.encode() for v in coded.dictionary.to_pylist()]
        # the first place is that of null
        slots = np.array([1 + int.from_bytes(hashlib.blake2b(v, digest_size=8).digest(), "little") % (width - 1) for v in values] + [0])
        at = coded.indices.fill_null(len(values)).to_numpy(zero_copy_only=False)
        out[np.arange(count), base + slots[at]] = 1
    declared = batch.column("n_chars").slice(first, count).to_pylist()
    out[:, -2] = [np.log1p(max(0, v or 0)) for v in declared]
    out[:, -1] = [v is None for v in declared]
    return out


class View:
    """Logistic regression on standardised dense columns and chosen hashed words."""

    def __init__(self, words: bool):
        self.words = words

    def fit(self, dense: np.ndarray, words: list[np.ndarray], y: np.ndarray) -> "View":
        self.mean, self.dev = dense.mean(axis=0), dense.std(axis=0) + 1e-6
        x = np.clip((dense - self.mean) / self.dev, -6, 6)
        self.chosen = self._choose(words, y) if self.words else np.zeros(0, np.int64)
        row, col = self._sparse(words)
        w, v, b = np.zeros(x.shape[1]), np.zeros(len(self.chosen)), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        theta = np.concatenate((w, v, [b]))
        m, s = np.zeros_like(theta), np.zeros_like(theta)
        for t in range(1, 401):
            z = x @ theta[: x.shape[1]] + np.bincount(row, weights=theta[x.shape[1] : -1][col], minlength=len(y)) + theta[-1]
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
            g = np.concatenate((x.T @ e, np.bincount(col, weights=e[row], minlength=len(self.chosen)), [e.sum()]))
            g[:-1] += 1e-5 * theta[:-1]
            m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
            theta = theta - 0.1 * (1 - t / 401) * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-9)
        self.w, self.v, self.b = theta[: x.shape[1]], theta[x.shape[1] : -1], theta[-1]
        return self

    def _choose(self, words: list[np.ndarray], y: np.ndarray, most: int = 4096) -> np.ndarray:
        n1, n0 = max(1.0, y.sum()), max(1.0, len(y) - y.sum())
        count = lambda rows: np.bincount(np.concatenate([words[i] for i in rows]), minlength=SLOTS) if len(rows) else np.zeros(SLOTS)
        c1, c0 = count(np.flatnonzero(y >= 0.5)), count(np.flatnonzero(y < 0.5))
        rate = (c1 + c0 + 1) / (n1 + n0 + 2)
        z = np.abs(c1 / n1 - c0 / n0) / np.sqrt(rate * (1 - rate) * (1 / n1 + 1 / n0))
        z[c1 + c0 < 8] = 0
        best = np.argsort(-z, kind="stable")[:most]
        return np.sort(best[z[best] > 4.5])

    def _sparse(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.chosen) or not len(words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        table = np.zeros(SLOTS, dtype=bool)
        table[self.chosen] = True
        at = np.concatenate(words)
        hit = np.flatnonzero(table[at])
        row = np.searchsorted(np.cumsum([len(x) for x in words]), hit, side="right")
        return row, np.searchsorted(self.chosen, at[hit])

    def score(self, dense: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
        row, col = self._sparse(words)
        x = np.clip((dense - self.mean) / self.dev, -6, 6)
        return x @ self.w + np.bincount(row, weights=self.v[col], minlength=len(dense)) + self.b


def _platt(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients of a logistic regression of y on the columns of z and 1, by Newton steps."""
    x = np.column_stack((z, np.ones(len(z))))
    a = np.zeros(x.shape[1])
    ridge = 1e-3 * np.eye(len(a))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        a = a - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ a)
    return a


def _chance(z: np.ndarray, a: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.column_stack((z, np.ones(len(z)))) @ a, -30, 30)))


class Pair:
    """Both views for one label. Rows are numbered; ``y`` is not a number where a label is unknown."""

    def __init__(self, dense: list[np.ndarray], words: list[np.ndarray], y: np.ndarray, seed: int):
        known = np.flatnonzero(~np.isnan(y))
        known = known[np.random.default_rng(seed).permutation(len(known))]
        self.held, train = known[: len(known) // 4], known[len(known) // 4 :]
        self.own = [{int(i): y[i] for i in train} for _ in range(2)]
        self.views = [View(True), View(False)]
        self.fit(dense, words, y)

    def fit(self, dense: list[np.ndarray], words: list[np.ndarray], y: np.ndarray) -> None:
        """Each view on its own rows, then calibrated on the held-out ones, then both together."""
        for side in range(2):
            i = np.array(sorted(self.own[side]))
            self.views[side].fit(dense[side][i], [words[j] for j in i], np.array([self.own[side][j] for j in i]))
        held = self.held
        z = np.column_stack([self._one(side, dense, words, held) for side in range(2)]) if len(held) else np.zeros((0, 2))
        self.calibrated = [_platt(z[:, [s]], y[held]) for s in range(2)] if len(held) else [np.array([1.0, 0.0])] * 2
        both = np.column_stack([z[:, [s]] * self.calibrated[s][0] + self.calibrated[s][1] for s in range(2)])
        self.joint = _platt(both, y[held]) if len(held) else np.array([1.0, 0.0, 0.0])

    def sides(self, text: np.ndarray, meta: np.ndarray, words: list[np.ndarray]) -> list[np.ndarray]:
        """The calibrated chance by each view."""
        return [_chance(v.score(d, words)[:, None], a) for v, d, a in zip(self.views, (text, meta), self.calibrated)]

    def _one(self, side: int, dense: list[np.ndarray], words: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
        return self.views[side].score(dense[side][rows], [words[i] for i in rows])

    def chance(self, text: np.ndarray, meta: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
        z = [v.score(d, words) for v, d in zip(self.views, (text, meta))]
        both = np.column_stack([s * a[0] + a[1] for s, a in zip(z, self.calibrated)])
        return _chance(both, self.joint)


def _features(batch: pa.RecordBatch, only: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Per chunk: first row, words, text view, metadata view, distinct hashed words (of ``only``)."""
    table = None
    if only is not None:
        table = np.zeros(SLOTS, dtype=bool)
        table[only] = True
    for i, data, offsets in text_chunks(batch.column("text")):
        start, end, h, bounds = hash_words(data, offsets, lower=True)
        text = style(data, offsets, start, end, h, bounds)
        slot = (h >> np.uint64(64 - BITS)).astype(np.int64)
        count = len(offsets) - 1
        if table is None:
            words = [np.unique(slot[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        else:
            at = np.flatnonzero(table[slot])
            pairs = np.unique((np.searchsorted(bounds, at, side="right") - 1) * SLOTS + slot[at])
            cut = np.searchsorted(pairs, np.arange(count + 1) * SLOTS)
            words = [pairs[a:b] % SLOTS for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        yield i, np.diff(bounds), text, metadata(batch, i, count), words


def _packed(words: list[np.ndarray]) -> list[bytes]:
    """Slots as numbers or, where that is shorter, as bits: SLOTS / 8 bytes at most."""
    out = []
    for x in words:
        if 4 * len(x) < SLOTS // 8:
            out.append(x.astype(np.int32).tobytes())
        else:
            bits = np.zeros(SLOTS, dtype=bool)
            bits[x] = True
            out.append(np.packbits(bits).tobytes())
    return out


def _unpacked(data: bytes) -> np.ndarray:
    if len(data) < SLOTS // 8:
        return np.frombuffer(data, dtype=np.int32)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, dtype=np.uint8)))


def _sample(docs: DataFrame, chosen: DataFrame) -> list[tuple]:
    """doc_id, text, meta and words of the chosen ids (unique, a bounded number), one
    row an id: the least by its features. Combined by id before they reach the driver."""
    sample = docs.join(F.broadcast(chosen.select("doc_id")), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, text, meta, words in _features(batch):
                part = batch.column("doc_id").slice(i, len(words))
                columns = [part, pa.array([x.tobytes() for x in text], pa.binary()), pa.array([x.tobytes() for x in meta], pa.binary()), pa.array(_packed(words), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "meta", "words"])

    rows = sample.mapInArrow(run, "doc_id long, text binary, meta binary, words binary")
    return rows.groupBy("doc_id").agg(F.min(F.struct("text", "meta", "words")).alias("f")).select("doc_id", "f.*").collect()


def _confident(docs: DataFrame, marks: DataFrame, made: dict[str, Pair], sure: float, rows_each: int, seed: int) -> list[tuple[int, list]]:
    """What the views teach each other: for each label, view and class the first
    ``rows_each`` documents by a hash of their id among ALL unlabelled ones that
    the view is sure of. Returns (doc_id, [(label, view, class)])."""
    only = np.unique(np.concatenate([p.views[0].chosen for p in made.values()]))
    kinds = [(name, side, y) for name in made for side in range(2) for y in (0, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, text, meta, words in _features(batch, only):
                flags = np.zeros(len(words), dtype=np.int64)
                chances = {name: pair.sides(text, meta, words) for name, pair in made.items()}
                for k, (name, side, y) in enumerate(kinds):
                    p = chances[name][side]
                    flags |= (p >= sure if y else p <= 1 - sure).astype(np.int64) << k
                some = np.flatnonzero(flags)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(i + some)), pa.array(flags[some])], names=["doc_id", "flags"])

    pool = docs.where("doc_id is not null").join(marks.select("doc_id"), "doc_id", "left_anti")
    sure_of = stored(pool.mapInArrow(run, "doc_id long, flags long"), "sure")
    out: dict[int, list] = {}
    for k, kind in enumerate(kinds):
        first = sure_of.where(F.col("flags").bitwiseAND(F.lit(1 << k)) != 0).select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(rows_each)
        for r in first.collect():
            out.setdefault(r["doc_id"], []).append(kind)
    return sorted(out.items())


def train(docs: DataFrame, labels: DataFrame, label_rows: int = 16_000, taught_rows: int = 1_000, rounds: int = 2, sure: float = 0.98, seed: int = 3) -> dict[str, Pair] | None:
    """Co-train; None if no label can be used.

    The fit uses at most ``label_rows`` labelled documents, the first by a hash
    of doc_id, and in each round at most ``taught_rows`` pseudo-labelled ones of
    each label, view and class, drawn from all documents that the view is sure
    of. These bounds are of labelled rows alone: every unlabelled document is
    judged in every round. A row that reaches the driver takes 32 KB at most.

    ``labels`` needs doc_id, quality and toxic. A document with several labels is
    bad if any says so; null labels teach nothing. Rows repeated under one id
    teach once.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", "n_chars")
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("double").alias("quality"), F.max("toxic").cast("double").alias("toxic"))
    marks = stored(marks.where("quality is not null or toxic is not null").withColumn("doc_id", F.col("doc_id").cast("long")), "marks")
    ids = docs.select("doc_id").where("doc_id is not null")
    known = marks.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(label_rows)
    known = stored(known, "known")
    mark = {r["doc_id"]: r for r in known.collect()}

    def read_rows(chosen: DataFrame) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
        rows = sorted(_sample(docs, chosen), key=lambda r: r["doc_id"])
        widths = (0, LANGS + SOURCES + 2)
        dense = [np.array([np.frombuffer(r[c]) for r in rows]).reshape(len(rows), -1 if rows else w) for c, w in zip(("text", "meta"), widths)]
        return [r["doc_id"] for r in rows], dense, [_unpacked(r["words"]) for r in rows]

    names, dense, words = read_rows(known)
    truth = {"low": [1 - mark[d]["quality"] if mark[d]["quality"] is not None else np.nan for d in names], "toxic": [mark[d]["toxic"] if mark[d]["toxic"] is not None else np.nan for d in names]}
    truth = {k: np.array(y, dtype=np.float64) for k, y in truth.items()}
    made = {k: Pair(dense, words, y, seed) for k, y in truth.items() if len(set(y[~np.isnan(y)])) == 2}
    if not made:
        return None
    at = {d: i for i, d in enumerate(names)}
    for _ in range(rounds):
        taught = _confident(docs, marks, made, sure, taught_rows, seed)
        fresh = [(d,) for d, _ in taught if d not in at]
        if fresh:
            more, inner, found = read_rows(docs.sparkSession.createDataFrame(fresh, "doc_id long"))
            at |= {d: len(at) + i for i, d in enumerate(more)}
            dense = [np.concatenate((x, y)) for x, y in zip(dense, inner)]
            words = words + found
        for d, kinds in taught:
            for name, side, y in kinds:
                made[name].own[1 - side].setdefault(at[d], float(y))
        for name, pair in made.items():
            pair.fit(dense, words, truth[name])
    return made


def classify(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, limit: float = 0.5, **options) -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: all), with n_words, p_low, p_toxic,
    score (the chance that the text is neither) and kept.

    ``docs`` needs doc_id, text, lang, source and n_chars; other columns pass
    through, unless they bear a name of the result. Every row is scored on its
    whole text, however long; null, empty and white texts are scored as empty.
    Nulls in lang, source and n_chars are values of their own. Repeated rows
    score alike. An empty table gives no row. A label without examples of both
    kinds is not learned, its chance is 0 and it rejects nothing.
    """
    made = train(docs, labels, **options) or {}
    names = [x.split()[0] for x in SCORES.split(", ")]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (*names, "score", "kept")]
    docs = docs.select(*dict.fromkeys([*keep, "text", "lang", "source", "n_chars"]))
    only = np.unique(np.concatenate([np.zeros(0, np.int64), *[p.views[0].chosen for p in made.values()]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, n, text, meta, words in _features(batch, only):
                part = batch.slice(i, len(n))
                chances = [made[k].chance(text, meta, words) if k in made else np.zeros(len(n)) for k in ("low", "toxic")]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(n.astype(np.int64)), *map(pa.array, chances)], names=[*keep, *names])
            trim()

    out = docs.mapInArrow(run, with_fields(docs.select(*keep), SCORES))
    return out.withColumn("score", (1 - F.col("p_low")) * (1 - F.col("p_toxic"))).withColumn("kept", (F.col("p_low") < limit) & (F.col("p_toxic") < limit))


def op9_cotrain(spark, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), keep=["doc_id"])
