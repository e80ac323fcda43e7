"""Toxicity: a convolutional text classifier in numpy.

A word's embedding is the sum of two hashed rows, one for the word and one for its
first bytes (so unseen forms of a known stem are not lost).  Filters of widths 1,
2 and 3 run over a text's words, each is max-pooled over the whole text, and a
logistic layer joins the pools.  Training is Adam on mini-batches; only the words at
a filter's maximum get gradients.  Decision thresholds are calibrated by language:
the language is guessed from the text's own function words (never from a column),
and each language's margins get a logistic scale of their own, drawn toward the
common one where a language has few rows.

Fitting uses at most ``POSITIVES`` + ``NEGATIVES`` labelled rows and
``labelled.SAMPLE_BYTES`` of text; all rows are scored from their whole texts by a
map, with the model (arrays of fixed size) broadcast.

Defined edge cases: null and empty texts have pools of zero and get a score from
them; without usable labels every score is 0.5, with one class only that class's
share; repeated rows are scored alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gleaner.llm.kernels import give_back, lower_table, prefix_hash, span_hash, text_bytes, words
from gleaner.llm.labelled import fit_logistic, labelled_sample
from gleaner.llm.quality import score_texts

POSITIVES, NEGATIVES = 3000, 5000
ROW_BITS, SIZE, STEM_BYTES = 16, 8, 5
WIDTHS, FILTERS = (1, 2, 3), 8

#: Frequent function words by language.
FUNCTION_WORDS = (
    ("en", "the of and to in is that for with was this are be it on as by at from or an"),
    ("de", "der die das und von zu den mit ist ein nicht für auf im sich des auch dem"),
    ("fr", "le la les de des et un une du en que qui dans pour est sur par au avec pas"),
    ("es", "el la los las de que y en un una por para con del se no es su al lo"),
)

#: Bytes between words: all ASCII but letters, digits and the apostrophe.
_GAP = np.zeros(256, bool)
_GAP[[b for b in range(128) if not (chr(b).isalnum() or chr(b) == "'")]] = True


def _hash_words(text: str) -> np.ndarray:
    data, offsets = text_bytes(pa.array([text]))
    starts, ends, _ = words(data, offsets, _GAP)
    return span_hash(prefix_hash(data, lower_table()), starts, ends)


def _language_table():
    """Sorted word hashes and, for each, which languages use it."""
    keys = np.unique(np.concatenate([_hash_words(w) for _, w in FUNCTION_WORDS]))
    member = np.stack([np.isin(keys, _hash_words(w)) for _, w in FUNCTION_WORDS], axis=1)
    # a word of several languages counts less
    return keys, member / member.sum(axis=1, keepdims=True)


_KEYS, _MEMBER = _language_table()


class Tokens:
    """Embedding rows of all words of some texts, and each text's language."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, self.first = words(data, offsets, _GAP)
        prefix = prefix_hash(data, lower_table())
        hashes = span_hash(prefix, starts, ends)
        stems = span_hash(prefix, starts, np.minimum(ends, starts + STEM_BYTES))
        shift = np.uint64(64 - ROW_BITS)
        self.word, self.stem = (hashes >> shift).astype(np.int32), (stems >> shift).astype(np.int32)
        at = np.minimum(np.searchsorted(_KEYS, hashes), len(_KEYS) - 1)
        votes = np.where((_KEYS[at] == hashes)[:, None], _MEMBER[at], 0.0)
        sums = np.concatenate([np.zeros((1, votes.shape[1])), np.cumsum(votes, axis=0)])
        sums = sums[self.first[1:]] - sums[self.first[:-1]]
        # the number after the last language is "unknown"
        self.language = np.where(sums.max(axis=1, initial=0) > 1e-9, sums.argmax(axis=1), len(FUNCTION_WORDS))

    def __len__(self):
        return len(self.first) - 1


class ConvModel:
    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        rows = 1 << ROW_BITS
        f32 = lambda x: x.astype(np.float32)
        self.p = {"word": f32(r.normal(0, 0.03, (rows, SIZE))), "stem": f32(r.normal(0, 0.03, (rows, SIZE)))}
        for w in WIDTHS:
            self.p[f"f{w}"] = f32(r.normal(0, (w * SIZE) ** -0.5, (w * SIZE, FILTERS)))
        self.p["out"] = f32(np.abs(r.normal(0, 0.3, len(WIDTHS) * FILTERS)))
        self.p["bias"] = np.zeros(1, np.float32)
        self.scale = [(1.0, 0.0)] * (len(FUNCTION_WORDS) + 1)

    def pools(self, t: Tokens, texts=None):
        """Pooled filters of each text, the word each maximum starts at, embeddings."""
        first = t.first
        x = self.p["word"][t.word] + self.p["stem"][t.stem]
        n = len(t)
        pooled = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        at = np.full(pooled.shape, -1, np.int64)
        for k, w in enumerate(WIDTHS):
            if len(x) < w:
                continue
            windows = x if w == 1 else np.concatenate([x[j : len(x) - w + 1 + j] for j in range(w)], axis=1)
            out = windows @ self.p[f"f{w}"]
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            for i in range(n):
                a, b = first[i], first[i + 1] - w + 1
                if b > a:
                    best = out[a:b].argmax(axis=0)
                    top = out[a + best, np.arange(FILTERS)]
                    pooled[i, cols] = np.maximum(top, 0)
                    at[i, cols] = np.where(top > 0, a + best, -1)
        return pooled, at, x

    def margins(self, t: Tokens) -> np.ndarray:
        first, x = t.first, self.p["word"][t.word] + self.p["stem"][t.stem]
        total = np.full(len(t), self.p["bias"][0], np.float64)
        for k, w in enumerate(WIDTHS):
            has = np.diff(first) >= w
            if not has.any():
                continue
            windows = x if w == 1 else np.concatenate([x[j : len(x) - w + 1 + j] for j in range(w)], axis=1)
            out = np.maximum(windows @ self.p[f"f{w}"], 0)
            if w > 1:  # windows that reach into the next text count as nothing
                for j in range(1, w):
                    over = first[1:-1] - j
                    out[over[(over >= 0) & (over < len(out))]] = 0
            top = np.maximum.reduceat(out, np.minimum(first[:-1][has], len(out) - 1), axis=0)
            total[has] += top @ self.p["out"][k * FILTERS : (k + 1) * FILTERS]
        return total

    def score(self, t: Tokens) -> np.ndarray:
        a, b = np.array(self.scale).T
        z = a[t.language] * self.margins(t) + b[t.language]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(model: ConvModel, batches: list[tuple[Tokens, np.ndarray, np.ndarray]], rounds: int, rate: float = 0.02) -> None:
    """Adam over (tokens, labels, row weights); rows of embeddings lazily."""
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    s = {k: np.zeros_like(v) for k, v in model.p.items()}
    order, step = np.random.default_rng(5), 0

    def adam(name, grad, rows=slice(None)):
        m[name][rows] = 0.9 * m[name][rows] + 0.1 * grad
        s[name][rows] = 0.99 * s[name][rows] + 0.01 * grad**2
        up, low = m[name][rows] / (1 - 0.9**step), s[name][rows] / (1 - 0.99**step)
        model.p[name][rows] -= (rate * up / (np.sqrt(low) + 1e-8)).astype(np.float32)

    for _ in range(rounds):
        for i in order.permutation(len(batches)):
            t, y, weight = batches[i]
            step += 1
            pooled, at, x = model.pools(t)
            p = 1 / (1 + np.exp(-np.clip(pooled @ model.p["out"] + model.p["bias"][0], -30, 30)))
            d = ((p - y) * weight / weight.sum()).astype(np.float32)
            back = d[:, None] * model.p["out"][None, :]
            grads = {"out": d @ pooled, "bias": np.array([d.sum()], np.float32)}
            rows_, grads_ = [], []
            for k, w in enumerate(WIDTHS):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                doc, f = np.nonzero(at[:, cols] >= 0)
                g, place = back[:, cols][doc, f], at[:, cols][doc, f]
                filters = model.p[f"f{w}"]
                grad = np.zeros_like(filters)
                for j in range(w):
                    part = np.zeros((FILTERS, SIZE), np.float32)
                    np.add.at(part, f, g[:, None] * x[place + j])
                    grad[j * SIZE : (j + 1) * SIZE] = part.T
                    rows_.append(place + j)
                    grads_.append(g[:, None] * filters[j * SIZE : (j + 1) * SIZE].T[f])
                grads[f"f{w}"] = grad + 1e-5 * filters
            place, g = np.concatenate(rows_), np.concatenate(grads_)
            for name, source in (("word", t.word), ("stem", t.stem)):
                rows, where = np.unique(source[place], return_inverse=True)
                total = np.zeros((len(rows), SIZE), np.float32)
                np.add.at(total, where, g)
                adam(name, total, rows)
            for name, grad in grads.items():
                adam(name, grad)
            # evidence only adds to toxicity, so a text without any keeps the bias's margin
            np.maximum(model.p["out"], 0, out=model.p["out"])


def fit(texts: list[str], y: np.ndarray, share: float, steps: int = 560, batch: int = 64) -> ConvModel:
    """Fit on three quarters of the rows in about ``steps`` batches, calibrate by language on the rest."""
    model = ConvModel()
    languages = len(FUNCTION_WORDS) + 1
    if len(y) == 0 or y.min() == y.max():
        p = 0.5 if len(y) == 0 else min(max(share, 0.01), 0.99)
        model.scale = [(0.0, float(np.log(p / (1 - p))))] * languages
        return model
    tokens = lambda some: Tokens(*text_bytes(pa.array(some, pa.large_string())))
    test = np.arange(len(y)) % 4 == 3
    if len(np.unique(y[~test])) < 2 or len(np.unique(y[test])) < 2:
        test = np.zeros(len(y), bool)
    rows = np.flatnonzero(~test)
    # both classes weigh alike while training
    even = np.where(y == 1, 0.5 / max(y[rows].mean(), 1e-9), 0.5 / max(1 - y[rows].mean(), 1e-9)).astype(np.float32)
    batches = [
        (tokens([texts[i] for i in part]), y[part].astype(np.float32), even[part])
        for part in (rows[i : i + batch] for i in range(0, len(rows), batch))
    ]
    train(model, batches, -(-steps // len(batches)))
    check = np.flatnonzero(test) if test.any() else rows
    margins, language = [], []
    for i in range(0, len(check), 256):
        t = tokens([texts[j] for j in check[i : i + 256]])
        margins.append(model.margins(t)), language.append(t.language)
    margins, language, mine = np.concatenate(margins), np.concatenate(language), y[check]
    weight = np.where(mine == 1, share / max(mine.mean(), 1e-9), (1 - share) / max(1 - mine.mean(), 1e-9))
    common = fit_logistic(margins, mine, weight)
    own = [language == k for k in range(languages)]
    model.scale = [fit_logistic(margins[o], mine[o], weight[o], common, 5.0) if o.any() else common for o in own]
    return model


def fit_toxicity(documents: DataFrame, labels: DataFrame, usable, label: str = "toxic") -> ConvModel:
    model = fit(*labelled_sample(documents, labels, label, usable, POSITIVES, NEGATIVES))
    give_back()  # what the sample took of the driver
    return model


def score_toxicity(df: DataFrame, model: ConvModel, text: str = "text", score: str = "score") -> DataFrame:
    """``df`` with the toxicity score of each whole text."""
    return score_texts(df, model, Tokens, text, score)
