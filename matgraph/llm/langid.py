"""Language ID by a linear-chain conditional random field over words.

Each word is labelled; a document's language has the largest sum of word
posteriors. Features of a word: its entry in the lexicon of the training sample,
prefixes and suffixes of one to three letters, and letter 2- and 3-grams with
word borders, hashed. Emission weights and transitions are learned jointly by
maximum likelihood (forward-backward, Adam) on chains of the sampled documents;
half the chains are spliced from two languages, so that the transitions learn
code-switching. Inference runs forward-backward on every word of every text, as one chain;
a text of more than ``BYTES`` goes block by block, forward and then back, with the messages
of a block's neighbours, so that only a block's words are held and the chain stays whole.

Defined results: a text that is null or has no letters is ``und`` with score 0;
words without letters carry the chain but no evidence; null labels are not
learned from; without any labelled row every text is ``und``; ties go to the
language that sorts first; every row gives one row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import block_spans, column_of, map_arrow, text_of
from ._sample import labelled_sample
from ._subwords import hashed, letters, picked_sums, sums

#: Words of a chain of the training sample, before it is spliced with another.
CHAIN = 64
BUCKETS = 1 << 16
#: Bounds of the training sample: documents of each language, and characters after which no
#: further one is taken.
SAMPLE_DOCS = 150
SAMPLE_CHARS = 500_000
STEPS = 60
#: Words whose emissions a worker holds.
CACHE = 150_000
#: Words that are labelled at once, or those of one text; and bytes of a block of a longer text.
BLOCK = 200_000
BYTES = 1 << 20


@dataclass
class Model:
    labels: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray
    transitions: np.ndarray

    def features(self, cores: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(index of the word, row of the weights) pairs; an empty word has none."""
        real = [i for i, c in enumerate(cores) if c]
        word, feat = hashed([cores[i] for i in real], (2, 3), (1, 2, 3), BUCKETS)
        known = [(i, f) for i in real if (f := self.lexicon.get(cores[i])) is not None]
        own = np.array(known, np.int64).reshape(-1, 2)
        return np.concatenate([np.array(real, np.int64)[word], own[:, 0]]), np.concatenate([feat, own[:, 1]])


def forward_backward(emit: np.ndarray, sizes: np.ndarray, transitions: np.ndarray, pairs: bool = False):
    """For chains of so many words (none 0) the posteriors of each word (emit: log potentials),
    and the expected transitions."""
    k = emit.shape[1]
    expected = np.zeros((k, k))
    if not len(sizes):
        return np.empty((0, k)), expected
    # The longest chains first, so that those that go on are a prefix; rows by place, then chain.
    by_length = np.argsort(-sizes, kind="stable")
    start = (np.cumsum(sizes) - sizes)[by_length]
    alive = np.searchsorted(-sizes[by_length], -np.arange(sizes.max()))
    end = np.cumsum(alive)
    place = np.repeat(np.arange(len(alive)), alive)
    row = start[np.arange(len(place)) - (end - alive)[place]] + place
    e = emit[row]
    e = np.exp(e - e.max(axis=1, keepdims=True))
    a = np.exp(transitions)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    cuts = [slice(x - n, x) for x, n in zip(end.tolist(), alive.tolist())]
    for t, now in enumerate(cuts):
        x = e[now] if t == 0 else (before[: now.stop - now.start] @ a) * e[now]
        before = alpha[now] = x / x.sum(axis=1, keepdims=True)
    for now, then in zip(cuts[-2::-1], cuts[:0:-1]):
        n = then.stop - then.start
        x = e[then] * beta[then]
        if pairs:
            y = x[:, None, :] * alpha[now][:n, :, None] * a
            expected += (y / y.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        x = x @ a.T
        beta[now.start : now.start + n] = x / x.sum(axis=1, keepdims=True)
    post = alpha * beta
    out = np.empty_like(post)
    out[row] = post / np.maximum(post.sum(axis=1, keepdims=True), 1e-300)
    return out, expected


def fit(sample: list[tuple[str, str]], seed: int = 7) -> Model:
    """From (text, language) pairs."""
    labels = sorted({y for _, y in sample})
    if not labels:
        return Model([], {}, np.zeros((BUCKETS, 0)), np.zeros((0, 0)))
    rng = np.random.default_rng(seed)
    chains: list[list[list[str]]] = []
    for label in labels:
        own = []
        for text, y in sample:
            if y == label:
                words = text.encode().split()
                own += [words[i : i + CHAIN] for i in range(0, len(words), CHAIN)]
        chains.append([[letters(w) for w in own[i]] for i in rng.permutation(len(own))])
    rows: list[tuple[list[str], list[int]]] = []
    for i, own in enumerate(chains):
        for words in own:
            gold = [i] * len(words)
            j = int(rng.integers(len(labels)))
            if rng.random() < 0.5 and chains[j]:
                other = chains[j][int(rng.integers(len(chains[j])))]
                cut = int(rng.integers(len(words) + 1))
                words, gold = words[:cut] + other[cut:], gold[:cut] + [j] * len(other[cut:])
            if words:
                rows.append((words, gold))
    count: dict[str, int] = {}
    for words, _ in rows:
        for w in words:
            count[w] = count.get(w, 0) + 1
    lexicon = {w: BUCKETS + i for i, w in enumerate(sorted(w for w, c in count.items() if c > 2 and w))}
    k = len(labels)
    model = Model(labels, lexicon, np.zeros((BUCKETS + len(lexicon), k)), np.zeros((k, k)))
    known = {w: i for i, w in enumerate(count)}
    word_of, feat = model.features(list(count))
    token = np.array([known[w] for words, _ in rows for w in words], np.int64)
    gold = np.array([y for _, ys in rows for y in ys], np.int64)
    sizes = np.array([len(w) for w, _ in rows], np.int64)
    one_hot = np.eye(k)[gold]
    follows = np.setdiff1d(np.arange(len(gold)), np.cumsum(sizes) - sizes)
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[follows - 1], gold[follows]), 1)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (model.weights, model.transitions)]
    for step in range(1, STEPS + 1):
        emit = picked_sums(word_of, model.weights, feat, len(count))
        post, expected = forward_backward(emit[token], sizes, model.transitions, pairs=True)
        by_word = sums(token, one_hot - post, len(count))
        grads = (
            picked_sums(feat, by_word, word_of, len(model.weights)) / len(token) - 1e-6 * model.weights,
            (seen - expected) / len(token) - 1e-6 * model.transitions,
        )
        for p, g, (m, v) in zip((model.weights, model.transitions), grads, state):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model.weights = model.weights.astype(np.float32)
    return model


class Labeller:
    """Applies a model; holds the emissions of a bounded number of words."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.emit = np.zeros((0, len(self.model.labels)), np.float32)
        self.real = np.zeros(0, bool)

    def _learn(self, words: list[bytes]) -> None:
        if len(self.index) > CACHE:
            self._clear()
        new = list(set(words).difference(self.index))
        if not new:
            return
        cores = list(map(letters, new))
        word, feat = self.model.features(cores)
        emit = sums(word, self.model.weights[feat], len(new)).astype(np.float32)
        self.index.update(zip(new, range(len(self.emit), len(self.emit) + len(new))))
        self.emit = np.concatenate([self.emit, emit])
        self.real = np.concatenate([self.real, np.fromiter(map(bool, cores), bool, len(cores))])

    def words(self, words: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(posteriors, has letters) for the words of documents of these sizes."""
        self._learn(words)
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        post, _ = forward_backward(self.emit[at].astype(np.float64), sizes, self.model.transitions)
        return post, self.real[at]

    def long(self, text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(posteriors, has letters) for the blocks of a long text, the last one first. The text is
        one chain: what a block's neighbours send it goes in as a word before and one after it."""
        known = np.exp(self.model.transitions)

        def chain(span, before, after):
            words = text[slice(*span)].split()
            self._learn(words)
            at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
            ends = [np.log(np.maximum(x, 1e-300))[None] for x in (before, after) if x is not None]
            emit = np.concatenate([*ends[: before is not None], self.emit[at].astype(np.float64), *ends[before is not None :]])
            post, _ = forward_backward(emit, np.array([len(emit)]), self.model.transitions)
            return post[before is not None :][: len(words)], self.real[at]

        spans = [span for span in block_spans(text, BYTES) if text[slice(*span)].split()]
        before: list[np.ndarray | None] = [None]
        for span in spans[:-1]:
            before.append(chain(span, before[-1], None)[0][-1])
        after = None
        for span, message in zip(spans[::-1], before[::-1]):
            post, real = chain(span, message, after)
            yield post, real
            after = post[0] if message is None else post[0] / np.maximum(message @ known, 1e-300)
            after = after / after.sum()

    def documents(self, texts: Iterable[bytes], n: int) -> tuple[list[str], list[float]]:
        """(language, score) of each of n texts."""
        total = np.zeros((n, len(self.model.labels) + 1))  # last: words with letters
        held: list[bytes] = []
        owner: list[int] = []
        sizes: list[int] = []

        def flush():
            if held:
                post, real = self.words(held, np.array(sizes))
                doc = np.repeat(owner, sizes)[real]
                for c in range(post.shape[1]):
                    total[:, c] += np.bincount(doc, post[real, c], n)
                total[:, -1] += np.bincount(doc, minlength=n)
            held.clear(), owner.clear(), sizes.clear()

        for i, text in enumerate(texts if self.model.labels else ()):
            if len(text) > BYTES:
                for post, real in self.long(text):
                    total[i, :-1] += post[real].sum(axis=0)
                    total[i, -1] += real.sum()
            elif words := text.split():
                held += words
                owner.append(i)
                sizes.append(len(words))
                if len(held) >= BLOCK:
                    flush()
        flush()
        some = total[:, -1] > 0
        best = total[:, :-1].argmax(axis=1) if self.model.labels else np.zeros(n, int)
        score = np.where(some, total[np.arange(n), best] / np.maximum(total[:, -1], 1), 0.0)
        return [self.model.labels[b] if s else "und" for b, s in zip(best, some)], np.clip(score, 0, 1).tolist()

    def labels_of(self, text: bytes) -> np.ndarray:
        """The number of each word's likeliest language, in order."""
        if len(text) > BYTES:
            return np.concatenate([np.zeros(0, np.int16), *[post.argmax(axis=1).astype(np.int16) for post, _ in self.long(text)][::-1]])
        words = text.split()
        return self.words(words, np.array([len(words)]))[0].argmax(axis=1) if words else np.zeros(0, np.int16)


def train(docs: DataFrame, fold: Column | None = None) -> Model:
    """Fit on a bounded sample of the rows of ``docs`` (doc_id, text, lang) that ``fold``
    admits: whole documents, SAMPLE_DOCS of each language."""
    rows = docs if fold is None else docs.filter(fold)
    return fit(labelled_sample(rows.select("doc_id", F.col("lang").alias("label")), docs, SAMPLE_DOCS, SAMPLE_CHARS))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score)."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    def of_batches(batches):
        own = Labeller(given.value)
        for batch in batches:
            langs, scores = own.documents(column_of(batch, 1), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    return map_arrow(rows, of_batches, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, min_score: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, whose text has a language with that score at
    least. Rows don't leave their task."""
    given = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def of_batches(batches):
        own = Labeller(given.value)
        for batch in batches:
            langs, scores = own.documents(((t or "").encode() for t in column_of(batch, at)), batch.num_rows)
            yield batch.filter(pa.array([x != "und" and s >= min_score for x, s in zip(langs, scores)], pa.bool_()))

    return map_arrow(docs, of_batches, docs.schema)


def spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang, first_word, n_words): runs of words of one language, for
    code-switched text. Words without letters go with the chain."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    def of_batches(batches):
        own = Labeller(given.value)
        labels = given.value.labels
        for batch in batches:
            rows: list[tuple] = []
            for i, text in zip(column_of(batch, 0), column_of(batch, 1)):
                best = own.labels_of(text) if labels else np.zeros(0, np.int16)
                cuts = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1], [True]))) if len(best) else ()
                rows += [(i, labels[best[a]], int(a), int(b - a)) for a, b in zip(cuts, cuts[1:])]
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["doc_id", "lang", "first_word", "n_words"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    return map_arrow(rows, of_batches, "doc_id long, lang string, first_word long, n_words long")
