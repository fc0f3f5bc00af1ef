"""Language identification: the average of hashed subword embeddings, a linear softmax, calibrated rejection.

Subwords are the runs of two to four characters of lower-cased words with their edges; each goes to one of 2^16
embeddings. The mean embedding of a text goes through a linear layer and a softmax. Both are trained by stochastic
gradient descent in numpy on a bounded sample of labelled texts. A part of the sample is set aside to find the
temperature that calibrates the probability, and the lowest score at which accepted texts reach the wanted accuracy.
A softmax is sure of texts in no language it knows too, so a text must also look like its language: the mean log share
of the language's learned texts that have each of its subwords must reach a floor. It lies between the least like text
of the part set aside and the same part with the letters of each word in random order.

For prediction the two linear maps are multiplied out into one table (embeddings x languages, so its size is fixed by
the number of languages), and a text's logits are the mean of its subwords' rows, over the whole text. So is its likeness.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import words as W

BITS = 16
ORDERS = (2, 3, 4)
UNKNOWN = "und"
_CHUNK = 1_000_000
_EDGE = 32
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x10000)])


def _is_letter(codes: np.ndarray) -> np.ndarray:
    out = _letters()[np.minimum(codes, 0xFFFF)]
    high = np.flatnonzero(codes > 0xFFFF)
    if len(high):
        out[high] = [chr(c).isalpha() for c in codes[high].tolist()]
    return out


def streams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts with one edge mark for every run of other characters, and where each text begins."""
    lowered = [f" {(t or '').lower()} " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), "<u4")
    begins = np.cumsum([0, *map(len, lowered)])
    letter = _is_letter(codes)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[begins[:-1]] = True
    return np.where(letter, codes, _EDGE)[keep], np.concatenate(([0], np.cumsum(keep)))[begins]


def subwords(stream: np.ndarray, order: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and bucket of each run of `order` characters that starts in [low, high) and has no edge inside."""
    part = stream[low:min(high + order - 1, len(stream))]
    n = len(part) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = np.ones(n, bool)
    h = np.full(n, order, np.uint64)
    for k in range(order):
        c = part[k:k + n]
        if 0 < k < order - 1:
            whole &= c != _EDGE
        h = (h ^ c) * _FACTORS[k]
    if order == 2:
        whole &= (part[:n] != _EDGE) | (part[1:n + 1] != _EDGE)
    h ^= h >> np.uint64(29)
    at = np.flatnonzero(whole)
    return at + low, ((h[at] * _FACTORS[0]) >> np.uint64(64 - BITS)).astype(np.int64)


def mean_rows(table: np.ndarray, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The mean of the table's rows over each text's subwords, and how many subwords it has."""
    stream, begins = streams(texts)
    total, count = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts), np.int64)
    for order in ORDERS:
        for low in range(0, len(stream), _CHUNK):
            at, bucket = subwords(stream, order, low, min(low + _CHUNK, len(stream)))
            text = np.searchsorted(begins, at, "right") - 1
            inside = at + order <= begins[text + 1]
            text, bucket = text[inside], bucket[inside]
            if len(text):
                first = np.flatnonzero(np.diff(text, prepend=-1))
                total[text[first]] += np.add.reduceat(table[bucket], first, axis=0)
                count[text[first]] += np.diff(np.append(first, len(text)))
    return total / np.maximum(count, 1)[:, None], count


def _window(text: str, letters: int) -> str:
    """A stretch of at most so many characters, at a place given by the text itself."""
    if len(text) <= letters:
        return text
    at = int(W.mix(np.array([len(text)], np.uint64))[0] % np.uint64(len(text) - letters))
    return text[at:at + letters]


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    stream, _ = streams([text])
    buckets = np.concatenate([subwords(stream, n, 0, len(stream))[1] for n in ORDERS])
    values, times = np.unique(buckets, return_counts=True)
    return values, (times / max(1, len(buckets))).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # logits of each bucket, over the temperature
    bias: np.ndarray
    threshold: float  # scores below it are rejected
    likeness: np.ndarray  # log share of each language's learned texts that have a bucket
    floor: float  # likenesses to the predicted language below it are rejected


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(texts: list[str], labels: list[str], dims: int = 16, epochs: int = 12, rate: float = 0.5, letters: int = 3000,
          accuracy: float = 0.98, seed: int = 7) -> Model:
    """Fit on the given texts (of longer ones a stretch of `letters` characters); every fifth calibrates."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 0.0, np.zeros((1 << BITS, 0), np.float32), 0.0)
    number = {v: i for i, v in enumerate(languages)}
    random = np.random.default_rng(seed)
    order = random.permutation(len(texts))
    bags = [_bag(_window(texts[i], letters)) for i in order]
    truth = np.array([number[labels[i]] for i in order])
    aside = np.arange(len(bags)) % 5 == 4
    if not aside.any() or len(set(truth[~aside].tolist())) < len(languages):
        aside[:] = False
    table = (random.random((1 << BITS, dims), np.float32) - 0.5) / dims
    weight, bias = np.zeros((dims, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    weight += random.standard_normal(weight.shape).astype(np.float32) / np.sqrt(dims)
    learn = np.flatnonzero(~aside)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in random.permutation(learn).tolist():
            at, share = bags[i]
            if not len(at):
                continue
            hidden = share @ table[at]
            error = _softmax(hidden @ weight + bias)
            error[truth[i]] -= 1
            back = weight @ error
            weight -= step * np.outer(hidden, error)
            bias -= step * 0.1 * error
            table[at] -= (step / (share @ share)) * share[:, None] * back  # moves the mean by one step
    check = np.flatnonzero(aside) if aside.any() else learn
    logits = np.array([bags[i][1] @ table[bags[i][0]] @ weight + bias for i in check]).reshape(len(check), -1)
    loss = [(-np.log(_softmax(logits / t)[np.arange(len(check)), truth[check]] + 1e-12).mean(), t) for t in np.geomspace(0.25, 16, 25)]
    heat = min(loss)[1]
    p = _softmax(logits / heat)
    score, right = p.max(1), p.argmax(1) == truth[check]
    down = np.argsort(-score, kind="stable")
    kept = np.cumsum(right[down]) / np.arange(1, len(down) + 1)
    good = np.flatnonzero(kept >= accuracy)
    # The lowest accepted score; no cut if all of them together are accurate enough, all is cut if none is.
    threshold = np.inf if not len(good) else 0.0 if good[-1] == len(down) - 1 else float(score[down[good[-1]]])
    having, texts_of = np.zeros((1 << BITS, len(languages)), np.float32), np.bincount(truth[learn], minlength=len(languages))
    for i in learn:
        having[bags[i][0], truth[i]] += 1
    likeness = np.log((having + 0.5) / (texts_of + 1)).astype(np.float32)
    like, unlike = [], []
    for i in check[right]:
        (at, share), v = bags[i], truth[i]
        if len(at):  # without itself if it was learned
            own = 0 if aside[i] else 1
            like.append(float(share @ np.log((having[at, v] - own + 0.5) / (texts_of[v] - own + 1))))
            words = _window(texts[order[i]], letters).split()
            at, share = _bag(" ".join("".join(random.permutation(list(w))) for w in words))
            unlike.append(float((share @ likeness[at]).max()) if len(at) else like[-1])
    # Between the least like text and texts of the same letters in no language.
    floor = min(min(like), (min(like) + float(np.median(unlike))) / 2) if like else -np.inf
    return Model(languages, (table @ weight / heat).astype(np.float32), bias / heat, threshold, likeness, floor)


def fit(documents: DataFrame, rows: int = 2000, key: str = "doc_id", text: str = "text", label: str = "lang") -> Model:
    """Train on about `rows` labelled documents, spread evenly over the languages, drawn by a hash of id, label and text.

    Rows that repeat one another are drawn once, so neither an id nor a text with many rows enlarges the sample. Only documents whose crc32(id as text) mod 5 is not 0 and whose label is not null take part.
    """
    learned = documents.where(~held_out(key) & F.col(label).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"), F.col(label).cast("string").alias("_label"))
    sizes = learned.groupBy("_label").agg(F.count(F.lit(1)).alias("_n"))
    languages = sizes.count()
    draw = F.pmod(F.xxhash64("_key", "_label", "_text"), F.lit(1_000_003)) / 1_000_003
    picked = learned.join(F.broadcast(sizes) if languages < 10_000 else sizes, "_label").where(
        draw * F.col("_n") < rows / max(languages, 1)).select("_key", "_text", "_label")
    # Long ones are cut where they are read: a stretch from their middle, so that the driver gets a bounded sample.
    middle = F.substring("_text", F.greatest((F.length("_text") / 2).cast("int") - 3000, F.lit(1)), F.lit(6000))
    cut = picked.select("_key", middle.alias("_text"), "_label").distinct()
    found = sorted((r["_label"], r["_text"]) for r in cut.collect())
    return train([t for _, t in found], [v for v, _ in found])


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is kept from learning; rows without an id are."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5 == 0


def scored(documents: DataFrame, model: Model, text: str = "text", into: str = "language") -> DataFrame:
    """The documents with a struct (lang, score, accepted).

    lang is `und` with score 0, not accepted, if the text is null or has no letter, or if nothing was learned.
    Otherwise it is the likeliest language, and accepted says whether the score reaches the model's threshold and the
    text is as like its language as the model's floor asks.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])

    @F.arrow_udf("lang string, score double, accepted boolean")
    def predict(column: pa.Array) -> pa.Array:
        m, langs, scores, accepted = held.value, [], [], []
        both = np.concatenate([m.table, m.likeness], axis=1)
        for first, last, *_ in W.pieces(column):
            rows, count = mean_rows(both, column.slice(first, last - first).to_pylist())
            if not m.languages:
                langs += [UNKNOWN] * len(count)
                scores += [0.0] * len(count)
                accepted += [False] * len(count)
                continue
            p = _softmax(rows[:, :len(m.languages)] + m.bias)
            best = p.argmax(1)
            like = rows[np.arange(len(rows)), len(m.languages) + best]
            accepted += ((count > 0) & (p.max(1) >= m.threshold) & (like >= m.floor)).tolist()
            langs += [m.languages[b] if n else UNKNOWN for b, n in zip(best.tolist(), count.tolist(), strict=True)]
            scores += np.where(count > 0, p.max(1), 0.0).tolist()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())], fields=list(kind))

    return documents.withColumn(into, predict(F.col(text).cast("string")))


def identified(documents: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) of every row, by a model learned from the table itself.

    Texts are used whole; label, id and other columns are no input of a prediction. Repeated and null ids are kept.
    An empty table gives an empty result.
    """
    rows = scored(documents.select(F.col(key).alias("doc_id"), F.col(text).alias("_text")), fit(documents, key=key, text=text, label=label), "_text", "_found")
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), F.col("_found.lang").alias("lang_pred"),
                       F.col("_found.score").alias("score"), F.col("_found.accepted").alias("accepted"))
