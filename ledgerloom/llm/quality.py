"""Quality rules: a linear-chain conditional random field marks each line as content or boilerplate.

Lines are described by the shares of character classes in them, their length, their ending and whether the text has
them already; each value falls into a bin, and each bin has a weight. Neighbouring lines are tied by transition
weights. The weights are fitted by gradient ascent on the conditional likelihood (forward-backward) over a bounded
sample of labelled documents whose lines take the label of their document. Prediction is exact Viterbi decoding of
every line of every text; a document stays if at least half of its words are in content lines.

Ahead of that, a document fails with fewer than 10 words, or if over 20 % of its words lie in five-word runs that the
text has twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import words as W

RUN = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # percent
SHARE = 0.5  # of words in content lines

_BYTES = np.arange(256)
_SPACE = np.isin(_BYTES, [9, 10, 11, 12, 13, 32])


def _class(text: str) -> np.ndarray:
    return np.isin(_BYTES, list(text.encode()))


_SYMBOL = _class("#*$%&|<>")
_CLASSES = [~_SPACE, (_BYTES >= 65) & (_BYTES <= 90), _class("0123456789"), _SYMBOL, _class("|"), _class("!?"), _class(".,;:"),
            (_BYTES & 0xC0) != 0x80]
_ENDING = _class(".!?:\"')")
# Values of a line and where their bins begin.
_BINS = [
    ("upper", [0.08, 0.2, 0.5]), ("digits", [0.5]), ("symbols", [0.005, 0.03, 0.08, 0.15]), ("bars", [0.005, 0.05]),
    ("marks", [0.01, 0.05, 0.1]), ("points", [0.005, 0.03, 0.08]), ("words", [3]), ("letters", [3, 4.5, 6, 8]),
    ("ending", [0.5]), ("seen", [0.5]),
]
N_FEATURES = sum(len(cuts) + 1 for _, cuts in _BINS)


@dataclass
class Lines:
    """Lines of some texts that have a word: the text of each, its words, and the columns of its features."""
    text: np.ndarray
    words: np.ndarray
    features: np.ndarray


def _repeated(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each row, whether an earlier row has the same owner and hash."""
    key = W.mix(h + W.mix(owner.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    out = np.zeros(len(h), bool)
    out[order[1:]] = key[order[1:]] == key[order[:-1]]
    return out


def measured(data: np.ndarray, edges: np.ndarray) -> tuple[dict[str, np.ndarray], Lines]:
    """Counts of each text and its lines; `edges` are where texts begin and end in the bytes."""
    n = len(edges) - 1
    starts, stops, at = W.spans(data, edges)
    h = W.hashes(data, starts, stops)
    totals = [np.concatenate(([0], np.cumsum(c[data], dtype=np.int64))) for c in _CLASSES]
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate((edges[:-1], breaks + 1)))
    begin = begin[begin < len(data)]
    end = np.append(begin[1:], len(data))[:len(begin)]
    end -= (end > begin) & (data[end - 1] == 10)
    first_word = np.searchsorted(starts, begin)
    words = np.searchsorted(starts, end) - first_word
    some = words > 0
    begin, end, words, first_word = begin[some], end[some], words[some], first_word[some]
    text = np.searchsorted(edges, begin, "right") - 1
    seen = _repeated(W.hashes(data, begin, end), text)
    runs = W.windows(h, RUN)
    owner = np.searchsorted(at, np.arange(len(h)), "right") - 1
    covered = np.zeros(len(h), bool)
    inside = np.flatnonzero(owner[:len(runs)] == owner[RUN - 1:RUN - 1 + len(runs)]) if len(runs) else np.zeros(0, np.int64)
    if len(inside):
        key = W.mix(runs[inside] + W.mix(owner[inside].astype(np.uint64)))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        twice = inside[order[np.append(same, False) | np.append(False, same)]]
        for k in range(RUN):
            covered[twice + k] = True
    counts = {
        "n_words": np.diff(at),
        "word_chars": np.diff(np.concatenate(([0], np.cumsum(~_SPACE[data] & _CLASSES[7][data], dtype=np.int64)))[edges]),
        "n_symbols": np.diff(totals[3][edges]),
        "n_dup_lines": np.bincount(text[seen], minlength=n),
        "n_repeat_words": np.bincount(owner[covered], minlength=n),
    }
    solid, upper, digits, symbols, bars, marks, points, chars = (t[end] - t[begin] for t in totals)
    per = np.maximum(solid, 1)
    last_word = stops[first_word + words - 1] - 1 if len(words) else np.zeros(0, np.int64)
    values = [upper / per, digits / per, symbols / per, bars / per, marks / per, points / per, words, chars / np.maximum(words, 1) - 1,
              _ENDING[data[last_word]], seen]
    columns, base = [], 0
    for value, (_, cuts) in zip(values, _BINS, strict=True):
        columns.append(np.digitize(value, cuts) + base)
        base += len(cuts) + 1
    return counts, Lines(text, words, np.stack(columns, 1).astype(np.int16))


@dataclass
class Model:
    weights: np.ndarray  # of each feature for content, over boilerplate
    moves: np.ndarray  # [from, to]; 0 is boilerplate, 1 content
    start: np.ndarray


def _padded(lines: Lines, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Line numbers as (text, position), and which are real."""
    size = np.bincount(lines.text, minlength=n)
    place = np.arange(len(lines.text)) - np.repeat(np.cumsum(size) - size, size)
    grid = np.zeros((n, max(1, int(size.max(initial=0)))), np.int64)
    real = np.zeros(grid.shape, bool)
    grid[lines.text, place], real[lines.text, place] = np.arange(len(lines.text)), True
    return grid, real


def _plus(x: np.ndarray, axis: int) -> np.ndarray:
    return np.logaddexp.reduce(x, axis=axis)


def train(lines: Lines, good: np.ndarray, rounds: int = 60, rate: float = 0.15, ridge: float = 1e-3, care: float = 0.9) -> Model:
    """Fit to lines whose label is that of their text.

    `care` is the weight of all good texts together, the bad ones have the rest: above one half, doubt is content.
    """
    model = Model(np.zeros(N_FEATURES), np.zeros((2, 2)), np.zeros(2))
    if not len(lines.text) or good.all() or not good.any():
        return model
    grid, real = _padded(lines, len(good))
    grid, real, label = grid[real[:, 0]], real[real[:, 0]], good[real[:, 0]].astype(int)
    share = np.where(label == 1, care / max(1, (label == 1).sum()), (1 - care) / max(1, (label == 0).sum()))
    theta = np.zeros(N_FEATURES + 6)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    steps = grid.shape[1]
    for turn in range(1, rounds + 1):
        weights, moves, start = theta[:N_FEATURES], theta[N_FEATURES:N_FEATURES + 4].reshape(2, 2), theta[N_FEATURES + 4:]
        score = weights[lines.features].sum(1)
        emit = np.stack((np.zeros(len(score)), score), 1)
        forward = np.zeros((steps, len(grid), 2))
        forward[0] = start + emit[grid[:, 0]]
        for t in range(1, steps):
            forward[t] = np.where(real[:, t, None], _plus(forward[t - 1][:, :, None] + moves, 1) + emit[grid[:, t]], forward[t - 1])
        norm = _plus(forward[-1], 1)
        backward = np.zeros((len(grid), 2))
        gain = np.zeros_like(theta)
        marginal = np.zeros(len(score))
        for t in range(steps - 1, -1, -1):
            on = real[:, t]
            p = np.exp(forward[t] + backward - norm[:, None])[:, 1]
            marginal[grid[on, t]] = p[on]
            if t:
                pair = np.exp(forward[t - 1][:, :, None] + moves + (emit[grid[:, t]] + backward)[:, None, :] - norm[:, None, None])
                pair *= (on * share)[:, None, None]
                gain[N_FEATURES:N_FEATURES + 4] -= pair.sum(0).ravel()
                gain[N_FEATURES] += (share * on)[label == 0].sum()
                gain[N_FEATURES + 3] += (share * on)[label == 1].sum()
                backward = np.where(on[:, None], _plus(moves + (emit[grid[:, t]] + backward)[:, None, :], 2), backward)
            else:
                gain[N_FEATURES + 4:] += [(share[label == 0]).sum() - (share * (1 - p)).sum(), (share[label == 1]).sum() - (share * p).sum()]
        truth, weight = np.zeros(len(score)), np.zeros(len(score))
        truth[grid[real]], weight[grid[real]] = np.repeat(label, real.sum(1)), np.repeat(share, real.sum(1))
        error = (truth - marginal) * weight
        gain[:N_FEATURES] = np.bincount(lines.features.ravel(), np.repeat(error, lines.features.shape[1]), N_FEATURES)
        gain -= ridge * theta
        first, second = 0.9 * first + 0.1 * gain, 0.99 * second + 0.01 * gain ** 2
        theta = theta + rate * (first / (1 - 0.9 ** turn)) / (np.sqrt(second / (1 - 0.99 ** turn)) + 1e-8)
    return Model(theta[:N_FEATURES], theta[N_FEATURES:N_FEATURES + 4].reshape(2, 2), theta[N_FEATURES + 4:])


def decode(model: Model, lines: Lines) -> np.ndarray:
    """Whether each line is content: the likeliest sequence of labels of each text."""
    n = int(lines.text.max(initial=-1)) + 1
    content = np.zeros(len(lines.text), bool)
    if not n:
        return content
    score = model.weights[lines.features].sum(1)
    size = np.bincount(lines.text, minlength=n)
    first = np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")  # texts with a line at some place are the first of these
    many = np.searchsorted(-size[order], -np.arange(size.max()), "left")
    best = np.zeros((n, 2))
    came = []
    for t, k in enumerate(many.tolist()):
        here = score[first[order[:k]] + t]
        if t == 0:
            best[:k] = model.start
        else:
            ways = best[:k, :, None] + model.moves
            came.append(ways.argmax(1))
            best[:k] = ways.max(1)
        best[:k, 1] += here
    state = best.argmax(1)
    for t in range(len(many) - 1, -1, -1):
        k = many[t]
        content[first[order[:k]] + t] = state[:k] == 1
        if t:
            state[:k] = came[t - 1][np.arange(k), state[:k]]
    return content


def fit(documents: DataFrame, labels: DataFrame, rows: int = 2000, letters: int = 4000, key: str = "doc_id", text: str = "text",
        label: str = "quality") -> Model:
    """Train on about `rows` labelled documents, half of them good, drawn by a hash of the id.

    Their ids, whose number is so bounded, go to the tasks that read the texts; of texts only the drawn stretches are
    shuffled. Of an id with several rows one text is learned from, that with the least hash.

    Of a longer text a stretch of `letters` characters from its middle is learned from. Without both labels the model
    takes every line for content.
    """
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("_good"))
    sizes = {r["_good"]: r["n"] for r in marks.groupBy((F.col("_good") > 0).alias("_good")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model(np.zeros(N_FEATURES), np.zeros((2, 2)), np.array([0.0, 1.0]))
    share = F.when(F.col("_good") > 0, rows / 2 / sizes[True]).otherwise(rows / 2 / sizes[False])
    picked = marks.where(F.pmod(F.xxhash64(key), F.lit(1_000_003)) / 1_000_003 < share)
    middle = F.substring(text, F.greatest((F.length(text) / 2).cast("int") - letters // 2, F.lit(1)), F.lit(letters))
    texts = documents.select(key, text).where(F.col(text).isNotNull())
    chosen = documents.sparkSession.createDataFrame(picked.select(key, "_good").collect(), picked.select(key, "_good").schema)
    drawn = texts.join(F.broadcast(chosen), key).groupBy(key, "_good").agg(F.min_by(middle, F.xxhash64(text)).alias("t"))
    found = sorted((r["t"], r["_good"] > 0) for r in drawn.collect())
    data = [t.encode() for t, _ in found]
    edges = np.cumsum([0, *map(len, data)])
    _, lines = measured(np.frombuffer(b"".join(data), np.uint8), edges)
    return train(lines, np.array([g for _, g in found], bool))


def judged(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share) of every row.

    A null text has no words and fails. Repeated rows and null ids give their own rows; other columns are not read;
    an empty table gives an empty result. Memory is bounded by a piece of texts or the longest text.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, edges in W.pieces(batch.column(1)):
                counts, lines = measured(data, edges)
                content = decode(held.value, lines)
                n = counts["n_words"]
                share = np.bincount(lines.text[content], lines.words[content], last - first) / np.maximum(n, 1)
                failed = (n < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), *[pa.array(counts[c].astype(np.int64)) for c in names],
                     pa.array(failed), pa.array(~failed & (share >= SHARE)), pa.array(share)],
                    ["doc_id", *names, "base_failed", "kept", "content_share"])

    plain = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in names) + ", base_failed boolean, kept boolean, content_share double")
