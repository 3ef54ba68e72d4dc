"""Toxicity by bags of subword embeddings and a linear softmax.

A word's vector is the mean of the vectors of its letter 3- to 6-grams (hashed,
with word borders), so that unseen misspellings share most of a known word's
vector. A bag is ``WINDOW`` consecutive words, of which repeats count once; the mean of its words' vectors is
read by a softmax over two classes, and a text scores as its most toxic bag, so
that a passage isn't lost in a long text. Embeddings and softmax are trained
jointly in numpy on a bounded, balanced sample: first on whole texts as bags,
then on each text's most toxic bag. The classes weigh alike in training, so a
score is the posterior at even shares; only with few labels of 1 is the bias drawn
to the true shares. As everything up to the softmax is linear, a word contributes one
number, which workers hold for a bounded number of words.

Defined results: a text that is null or has no letters scores the share of toxic
labels; without labels of both classes every score is that share (0 without
labels); a very long text is scored block by block, with windows over the borders; documents with several labels count once for each; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import column_of, map_arrow, text_of, word_blocks
from ._sample import labelled_sample
from ._subwords import hashed, letters, picked_sums, sums

GRAMS = (3, 4, 5, 6)
BUCKETS = 1 << 17
SIZE = 8
#: Bounds of the training sample: documents of each class, that are read whole, and characters
#: after which no further one is taken.
SAMPLE_DOCS = 1000
SAMPLE_CHARS = 5_000_000
WARM_UP, STEPS = 15, 25
#: Words of a bag, not counting those without letters.
WINDOW = 12
#: Words of the sample that a bucket must occur in, fewer where there are few texts of label 1;
#: and what each step takes off a bucket's vector, as a share of the step.
LEAST, LEAST_OF_FEW, PER_TEXT, LASSO = 30, 4, 9, 2.0
#: With so many texts of label 1 in the sample, the bias is halfway to the true shares.
PRIOR = 50
CACHE = 150_000
#: Words that are scored at once, and bytes of a longer text that are split at once.
BLOCK = 120_000
BYTES = 1 << 20


@dataclass
class Model:
    """What each bucket and the bias add to the log odds of label 1; prior: its log
    odds among all labels."""

    buckets: np.ndarray
    bias: float
    prior: float

    def words(self, cores: list[str]) -> np.ndarray:
        word, feat = hashed(cores, GRAMS, (), BUCKETS)
        n = np.bincount(word, minlength=len(cores))
        return np.bincount(word, self.buckets[feat], len(cores)) / np.maximum(n, 1)


def gaps(word: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many words ago each word of texts of these sizes was used last, WINDOW if that is more."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    by = np.lexsort((word, text))
    again = (word[by][1:] == word[by][:-1]) & (text[by][1:] == text[by][:-1])
    gap = np.full(len(word), WINDOW)
    gap[by[1:][again]] = np.minimum(np.diff(by)[again], WINDOW)
    return gap


def best_windows(values: np.ndarray, gap: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts of so many words (none 0), the start of the window whose mean value is
    largest, and that mean; a word that repeats in a window counts once. A shorter text is one window."""
    ends = np.cumsum(sizes)
    width = np.repeat(np.minimum(sizes, WINDOW), sizes)
    total = np.concatenate(([0.0], np.cumsum(values)))
    at = np.arange(len(values))
    inside = at + width <= np.repeat(ends, sizes)
    # What windows that begin at or before a word's last use count too often.
    k = np.flatnonzero(gap < WINDOW)
    twice = np.zeros(len(values) + 1)
    np.add.at(twice, np.maximum(np.repeat(ends - sizes, sizes)[k], k - WINDOW + 1), values[k])
    np.add.at(twice, k - gap[k] + 1, -values[k])
    mean = np.where(inside, (total[np.minimum(at + width, len(values))] - total[at] - np.cumsum(twice[:-1])) / width, -np.inf)
    top = np.maximum.reduceat(mean, ends - sizes)
    hit = np.flatnonzero(mean == np.repeat(top, sizes))
    owner = np.searchsorted(ends, hit, side="right")
    first = np.empty(len(sizes), np.int64)
    first[owner[::-1]] = hit[::-1]
    return first, top


def fit(sample: list[tuple[str, int]], share: float, seed: int = 11) -> Model:
    """From (text, label) pairs, labels 0 and 1; share: of label 1 among all labels."""
    rng = np.random.default_rng(seed)
    log_odds = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    index: dict[str, int] = {}
    word, sizes, gold = [], [], []
    for text, y in sample:
        if own := [core for w in text.encode().split() if (core := letters(w))]:
            word += [index.setdefault(core, len(index)) for core in own]
            sizes.append(len(own))
            gold.append(int(y))
    word, sizes, gold = np.array(word, np.int64), np.array(sizes, np.int64), np.array(gold, np.int64)
    if len(set(gold.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), log_odds, log_odds)
    of, feat = hashed(list(index), GRAMS, (), BUCKETS)
    grams = np.bincount(of, minlength=len(index))
    # A bucket met in a few bags only would be learned by heart; its vector stays zero.
    bags_with = np.bincount(word, minlength=len(index))
    common = np.bincount(feat, bags_with[of], BUCKETS) >= min(LEAST, LEAST_OF_FEW + int(gold.sum()) // PER_TEXT)
    by_word = np.flatnonzero(common[feat])[np.argsort(of[common[feat]], kind="stable")]
    feat, of = feat[by_word], of[by_word]
    kept = np.bincount(of, minlength=len(index))
    starts = np.concatenate(([0], np.cumsum(kept)))
    params = [rng.normal(0, 0.1, (BUCKETS, SIZE)) * common[:, None], rng.normal(0, 0.1, (SIZE, 2)), np.zeros(2)]
    vectors, softmax, bias = params
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    # Rows for each word of the sample are single precision; they are what takes memory.
    gap = gaps(word, sizes)
    one_hot = np.eye(2)[gold]
    weight = (0.5 / np.bincount(gold, minlength=2))[gold][:, None]
    for step in range(1, WARM_UP + STEPS + 1):
        if step <= WARM_UP:
            at, bag = np.arange(len(word)), np.repeat(np.arange(len(sizes)), sizes)
            offset = WINDOW - 1  # of a whole text, a word that wasn't used shortly before
        else:
            odds = vectors @ (softmax[:, 1] - softmax[:, 0])
            value = np.bincount(of, odds[feat], len(index)) / np.maximum(grams, 1)
            first, _ = best_windows(value[word], gap, sizes)
            width = np.minimum(sizes, WINDOW)
            bag = np.repeat(np.arange(len(sizes)), width)
            offset = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            at = np.repeat(first, width) + offset
        used, token = np.unique(word[at], return_inverse=True)
        once = (gap[at] > offset).astype(np.float32)[:, None]
        n = kept[used]
        pick = np.repeat(starts[used] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        f, w = feat[pick], np.repeat(np.arange(len(used)), n)
        size = np.bincount(bag, minlength=len(sizes))[:, None]
        all_of = np.maximum(grams[used], 1)[:, None]
        words = (picked_sums(w, vectors, f, len(used)) / all_of).astype(np.float32)
        bags = sums(bag, words[token] * once, len(sizes)) / size
        z = bags @ softmax + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        off = (p - one_hot) * weight
        back = sums(token, (off @ softmax.T / size).astype(np.float32)[bag] * once, len(used)) / all_of
        grads = (picked_sums(f, back, w, BUCKETS), bags.T @ off + 1e-4 * softmax, off.sum(axis=0))
        rate = 0.3 if step <= WARM_UP else 0.1
        for q, g, (m, v) in zip(params, grads, state):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        # Group lasso: a bucket that doesn't gain steadily goes to zero, and makes no noise.
        norm = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
        vectors *= np.maximum(0, 1 - LASSO * rate / np.maximum(norm, 1e-12))
    odds = softmax[:, 1] - softmax[:, 0]
    return Model((vectors @ odds).astype(np.float32), float(bias[1] - bias[0]) + log_odds * PRIOR / (PRIOR + (gold == 1).sum()), log_odds)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.index: dict[bytes, int] = {}
        self.value = np.zeros(0)
        self.real = np.zeros(0, bool)

    def _learn(self, words: list[bytes]) -> None:
        if len(self.index) > CACHE:
            self.index, self.value, self.real = {}, np.zeros(0), np.zeros(0, bool)
        new = list(set(words).difference(self.index))
        cores = list(map(letters, new))
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
        self.value = np.concatenate([self.value, self.model.words(cores)])
        self.real = np.concatenate([self.real, np.fromiter(map(bool, cores), bool, len(cores))])

    def documents(self, texts: Iterable[bytes], n: int) -> np.ndarray:
        """The score of each of n texts."""
        best = np.full(n, -np.inf)
        held: list[bytes] = []
        sizes: list[int] = []
        owner: list[int] = []

        def flush():
            self._learn(held)
            at = np.fromiter(map(self.index.__getitem__, held), np.int64, len(held))
            real = self.real[at]
            part = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[real], minlength=len(sizes))
            some = part > 0
            if some.any():
                _, top = best_windows(self.value[at[real]], gaps(at[real], part[some]), part[some])
                np.maximum.at(best, np.array(owner, np.int64)[some], top)
            held.clear(), sizes.clear(), owner.clear()

        def put(words: list[bytes], i: int):
            held.extend(words)
            sizes.append(len(words))
            owner.append(i)
            if len(held) >= BLOCK:
                flush()

        for i, text in enumerate(texts):
            if len(text) <= BYTES:
                put(text.split(), i)
                continue
            # The words with letters, block by block, each with the last of those before it, so that
            # every window of the text is in one block.
            tail: list[bytes] = []
            whole = False
            for words in word_blocks(text, BYTES):
                words = tail + list(filter(letters, words))
                tail = words
                if len(words) >= WINDOW:
                    put(words, i)
                    tail, whole = words[1 - WINDOW :], True
            if not whole:
                put(tail, i)
        flush()
        some = np.isfinite(best)
        odds = np.where(some, np.where(some, best, 0) + self.model.bias, self.model.prior)
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def train(docs: DataFrame, labels: DataFrame, fold: Column | None = None, label_col: str = "toxic") -> Model:
    """Fit on a bounded sample of the labelled rows that ``fold`` (on doc_id) admits: whole
    documents, SAMPLE_DOCS of each class."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)")
    labels = labels if fold is None else labels.filter(fold)
    counts = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    share = counts.get(1, 0) / max(sum(counts.values()), 1)
    return fit(labelled_sample(labels, docs, SAMPLE_DOCS, SAMPLE_CHARS), share)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score)."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    def of_batches(batches):
        own = Scorer(given.value)
        for batch in batches:
            scores = own.documents(column_of(batch, 1), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    return map_arrow(rows, of_batches, "doc_id long, score double")
