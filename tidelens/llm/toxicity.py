"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.llm._shared import begin, materialise, need

#: Labelled rows a model is fitted on at most (those with the smallest hashes), and the buckets that hashed terms fall in.
ROWS, BUCKETS = 30_000, 1 << 18
#: Choice of features among the buckets: documents a bucket must be in; standard errors by which its share of toxic texts must
#: differ, and buckets so kept; buckets tested in pairs, standard errors by which a pair's share must differ from what
#: its two buckets' shares add up to, and pairs so kept.
LEAST, ERRORS, SINGLE, TESTED, PAIR_ERRORS, PAIRS = 4, 4.0, 2048, 1024, 6.0, 256
STEMS = (4, 5, 7)
#: Training; POSITIVE is the weight of a toxic text, as texts that are not are many times as many.
FACTORS, EPOCHS, BATCH, RATE, DECAY, POSITIVE = 8, 20, 256, 0.3, 5e-5, 3.0
#: Rows of the pair test multiplied at a time, words remembered in a worker.
BLOCK, REMEMBERED = 2048, 200_000
#: ASCII to lower case for letters, itself for digits, white space for the rest; bytes of other characters stay.
PLAIN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str | None) -> set[bytes]:
    """The runs of letters and digits of a whole text, in lower case."""
    return set((text or "").lower().encode().translate(PLAIN).split())


def buckets(word: bytes) -> tuple[int, ...]:
    """The buckets of a word and of its first STEMS bytes with a hyphen, so that inflected words share some."""
    return tuple([crc32(x) % BUCKETS for x in (word, *[word[:n] + b"-" for n in STEMS if len(word) > n])])


class _Remembered(dict):
    def __init__(self, of: Callable):
        self.of = of

    def __missing__(self, word: bytes):
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = x = self.of(word)
        return x


def terms(text: str | None, of: Callable = buckets) -> np.ndarray:
    """The distinct buckets of a whole text's terms, ascending."""
    return np.array(sorted(set().union(*map(of, words(text)))), np.uint32)


def logits(doc: np.ndarray, i: np.ndarray, n: int, bias: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """bias + sum_i w_i + sum_{i<j} <v_i, v_j> of ``n`` texts, whose features are ``i`` (of text ``doc``); v_i, and each text's sum of them."""
    vi = v[i]
    total = np.stack([np.bincount(doc, vi[:, f], n) for f in range(v.shape[1])], axis=1)
    own = np.bincount(doc, (vi * vi).sum(axis=1), n)
    return bias + np.bincount(doc, w[i], n) + 0.5 * ((total * total).sum(axis=1) - own), vi, total


def gradient(doc: np.ndarray, i: np.ndarray, err: np.ndarray, vi: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features that occur, and the mean loss's derivatives by their w and v; ``err``: derivative of a text's loss by its logit."""
    e = err[doc]
    touched, back = np.unique(i, return_inverse=True)
    dw = np.bincount(back, e, len(touched)) / len(err)
    return touched, dw, np.stack([np.bincount(back, e * (total[doc, f] - vi[:, f]), len(touched)) for f in range(vi.shape[1])], axis=1) / len(err)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass(frozen=True)
class Machine:
    """score = sigmoid(bias + sum_i w_i + sum_{i<j} <v_i, v_j>) over the known buckets i, j of a text."""

    known: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def find(self, some: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.isin(self.known, some, assume_unique=True))

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """The scores of texts given by the places of their known buckets, each once."""
        doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        return sigmoid(logits(doc, np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64), len(rows), self.bias, self.linear, self.factors)[0])

    def score(self, some: np.ndarray) -> float:
        return float(self.scores([self.find(some)])[0])


def _apart(p: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Standard errors between a share ``p`` among ``n`` and the expected one ``q``."""
    return np.abs(p - q) * np.sqrt(n / (q * (1 - q)))


def single_features(inside: np.ndarray, toxic: np.ndarray, rows: int, positive: int) -> np.ndarray:
    """Places of the buckets whose own share of toxic texts differs most from the share of all texts."""
    z = _apart(toxic / np.maximum(inside, 1), positive / rows, inside)
    z[(inside < LEAST) | (z < ERRORS)] = -1
    return np.argsort(-z, kind="stable")[: min(SINGLE, int((z >= 0).sum()))]


def tested_features(inside: np.ndarray, rows: int) -> np.ndarray:
    """Places of the buckets tested in pairs: those whose presence varies most, whatever their own share of toxic texts."""
    spread = np.where(inside >= LEAST, inside * (rows - inside), 0)
    return np.argsort(-spread, kind="stable")[: min(TESTED, int((spread > 0).sum()))]


def paired_features(rows: list[np.ndarray], labels: np.ndarray, m: int) -> np.ndarray:
    """Of ``m`` features (``rows``: each text's), those of the pairs whose share of toxic texts differs most from what the
    two features' own shares give as a sum of log odds."""
    both, toxic = np.zeros((m, m), np.float64), np.zeros((m, m), np.float64)
    for at in range(0, len(rows), BLOCK):
        x = np.zeros((min(BLOCK, len(rows) - at), m), np.float32)
        for k, r in enumerate(rows[at : at + BLOCK]):
            x[k, r] = 1
        y = x[labels[at : at + BLOCK] > 0]
        both += x.T @ x
        toxic += y.T @ y
    inside, share = np.diag(both), (labels.sum() + 1) / (len(rows) + 2)
    p = (np.diag(toxic) + 2 * share) / (inside + 2)
    odds = np.log(p / (1 - p))
    expected = np.clip(sigmoid(odds[:, None] + odds[None, :] - np.log(share / (1 - share))), 0.01 * share, 1 - 0.01 * (1 - share))
    z = np.triu(np.where(both >= LEAST, _apart(toxic / np.maximum(both, 1), expected, both), 0), 1).ravel()
    best = np.argsort(-z, kind="stable")[:PAIRS]
    best = best[z[best] >= PAIR_ERRORS]
    return np.unique([best // m, best % m])


def fit(rows: list[np.ndarray], labels: np.ndarray, m: int, seed: int = 3) -> tuple[float, np.ndarray, np.ndarray]:
    """bias, w and v of ``m`` features; ``rows``: each text's. Logistic loss by AdaGrad in mini-batches."""
    n = len(rows)
    share = (labels.sum() + 1) / (n + 2)
    rng = np.random.default_rng(seed)
    bias, w, v = float(np.log(share / (1 - share))), np.zeros(m), rng.normal(0, 0.02, (m, FACTORS))
    if not m:
        return bias, w, v
    at = np.concatenate(rows).astype(np.int64)
    begin = np.r_[0, np.cumsum([len(r) for r in rows])]
    gw, gv, gb = np.full(m, 1e-4), np.full((m, FACTORS), 1e-4), 1e-4
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for s in range(0, n, BATCH):
            docs = order[s : s + BATCH]
            count = begin[docs + 1] - begin[docs]
            doc = np.repeat(np.arange(len(docs)), count)
            i = at[np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[docs], count)]
            y, vi, total = logits(doc, i, len(docs), bias, w, v)
            err = (sigmoid(y) - labels[docs]) * np.where(labels[docs] > 0, POSITIVE, 1.0)
            touched, dw, dv = gradient(doc, i, err, vi, total)
            dw, dv = dw + DECAY * w[touched], dv + DECAY * v[touched]
            gb += err.mean() ** 2
            gw[touched] += dw * dw
            gv[touched] += dv * dv
            bias -= RATE * err.mean() / np.sqrt(gb)
            w[touched] -= RATE * dw / np.sqrt(gw[touched])
            v[touched] -= 0.5 * RATE * dv / np.sqrt(gv[touched])
    return float(bias), w, v


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begin("toxicity")
    of = _Remembered(buckets).__getitem__
    for b in batches:
        rows = [terms(x.as_py(), of).astype("<u4").tobytes() for x in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.binary())], ["of", "label", "terms"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows of a partition, and how many toxic ones, have each bucket."""
    inside = np.zeros((2, BUCKETS), np.int64)
    for b in batches:
        label = b.column(0).to_numpy()
        for k, some in ((0, b.column(1)), (1, b.column(1).filter(pa.array(label > 0)))):
            inside[k] += np.bincount(np.frombuffer(b"".join(some.to_pylist()), "<u4"), minlength=BUCKETS)
    at = np.flatnonzero(inside[0])
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(inside[0][at]), pa.array(inside[1][at])], ["bucket", "n", "toxic"])


def _places(some: np.ndarray) -> Callable:
    """The places among ``some`` (ascending) of each row's buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.flatnonzero(np.isin(some, np.frombuffer(x.as_py(), "<u4"), assume_unique=True)).astype("<u2").tobytes() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], ["label", "places"])

    return run


def held_out(doc_id: str = "doc_id"):
    """Whether a row's label is kept for measuring: crc32 of its doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Machine:
    """Fit on at most ``rows`` labelled documents that are not held out; repeated labels of a doc_id count once (the larger).

    ``docs`` has ``doc_id`` and ``text``, ``labels`` has ``doc_id`` and ``toxic``; rows with nulls teach nothing. Of rows
    that repeat a doc_id the one with the smallest buckets teaches. Features are hash buckets of terms, chosen by their own
    share of toxic texts or by their share in pairs; without rows of both labels the score is the labels' smoothed share.
    The driver gets a count for each bucket (BUCKETS at most) and, for each of these ``rows``, the places of its
    features (SINGLE + TESTED at most), never texts.
    """
    known = need(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").where(~held_out())
    known = known.groupBy(F.col("doc_id").alias("of")).agg(F.max(F.col("toxic").cast("int")).alias("label"))
    known = known.orderBy(F.xxhash64("of"), "of").limit(rows)  # a bounded table, so it may be broadcast
    some = need(docs, "doc_id", "text").where("text is not null").join(F.broadcast(known), F.col("doc_id") == F.col("of"))
    some = some.select("of", "label", "text").mapInArrow(_hashed, "of bigint, label int, terms binary")
    some = materialise(some.groupBy("of").agg(F.min(F.struct("label", "terms")).alias("row")).select("row.*"), "labelled")
    n, positive = some.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < positive < n:
        share = (positive + 1) / (n + 2)
        return Machine(np.zeros(0, np.uint32), float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, FACTORS)))
    counts = some.mapInArrow(_counted, "bucket bigint, n bigint, toxic bigint").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    counts = counts.toArrow().sort_by("bucket")
    bucket, inside, toxic = (counts.column(c).to_numpy() for c in ("bucket", "n", "toxic"))
    alone, tested = single_features(inside, toxic, n, positive), tested_features(inside, n)
    either = np.union1d(alone, tested)
    found = some.mapInArrow(_places(bucket[either]), "label int, places binary").toArrow()
    found = sorted(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True))
    marked, y = [np.frombuffer(p, "<u2") for _, p in found], np.array([x for x, _ in found], np.float64)
    at = _only(marked, np.searchsorted(either, np.sort(tested)))
    kept = np.union1d(alone, np.sort(tested)[paired_features(at, y, len(tested))])
    bias, w, v = fit(_only(marked, np.searchsorted(either, kept)), y, len(kept))
    return Machine(bucket[kept].astype(np.uint32), bias, w, v)


def _only(rows: list[np.ndarray], some: np.ndarray) -> list[np.ndarray]:
    """The features of ``rows`` that are among ``some`` (ascending), as places in it."""
    new = np.full(SINGLE + TESTED, -1)
    new[some] = np.arange(len(some))
    return [x[x >= 0] for x in (new[r] for r in rows)]


def _scored(machine: Machine, text: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("toxicity")
        place = {int(b): i for i, b in enumerate(machine.known)}
        of = _Remembered(lambda word: tuple([place[b] for b in buckets(word) if b in place])).__getitem__
        for b in batches:
            rows = [terms(x.as_py(), of) for x in b.column(text)]
            yield b.append_column("__toxicity", pa.array(machine.scores(rows), pa.float64()))

    return run


def score(docs: DataFrame, machine: Machine, name: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``name``: the machine's score of the whole text, from 0 to 1.

    Null and empty texts, and those without known terms, get the score of no terms. Nothing but the text is read.
    An empty table gives an empty one.
    """
    row = docs.withColumnRenamed(name, f"__{name}_before") if name in docs.columns else docs
    fields = ", ".join(f"`{c}` {t}" for c, t in [*row.dtypes, ("__toxicity", "double")])
    out = row.mapInArrow(_scored(machine, row.columns.index("text")), fields)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c != name], F.col("__toxicity").alias(name))
