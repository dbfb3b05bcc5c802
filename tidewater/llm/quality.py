"""Quality rules: a linear-chain conditional random field labels the lines of a document.

Each line that isn't blank is content or boilerplate. Its features are shares of
byte classes, word lengths, repeated words and its ends; the chain adds a weight
for each pair of neighbouring labels. The weights maximise the conditional
likelihood of line labels on a bounded sample of labelled documents; Viterbi
decoding finds the best labels of every line of every document. A document stays
if the content lines hold at least MIN_SHARE of the bytes of its lines.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import common as C

MIN_SHARE = 0.5
#: Labelled documents of each class that the model is fitted on, those of least hash of the id; the bound of training, not of scoring.
TRAIN_PER_CLASS = 1000
#: A training document of more lines is fitted as several chains.
CHAIN = 32
FEATURES = ("bias", "letters", "upper", "digits", "spaces", "symbols", "bangs", "stops", "length", "word_length", "short_words", "repeat_1", "repeat_2", "ends_sentence", "starts_upper")


def _pair(a: bytes | list[int], b: bytes | list[int]) -> np.ndarray:
    table = np.zeros(256, np.uint64)
    table[[*a]] += np.uint64(1)
    table[[*b]] += np.uint64(1 << 32)
    return table


_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
# Continuation bytes belong to the character before, so only lead bytes count as letters.
_TABLES = (_pair([*_UPPER, *_LOWER, *range(0xC0, 256)], _UPPER), _pair(b"0123456789", b" \t\r"), _pair(b"#$%&*|<>{}[]=~^\\_/@+", b"!?"), _pair(b".,;:'\"", [*range(0x80, 0xC0)]))


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines, and the number of lines of each document (at least one)."""
    newline = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((offsets[:-1], newline + 1)))
    ends = np.sort(np.concatenate((offsets[1:], newline)))
    return starts, ends, 1 + np.diff(np.searchsorted(newline, offsets))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features of the lines that aren't blank, their bytes, which lines those are, lines per document)."""
    starts, ends, per = lines_of(data, offsets)
    counts = []
    for table in _TABLES:
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data], out=run[1:])
        both = run[ends] - run[starts]
        counts += [(both & np.uint64(0xFFFFFFFF)).astype(float), (both >> np.uint64(32)).astype(float)]
    letters, upper, digits, spaces, symbols, bangs, stops, more = counts
    size = (ends - starts).astype(float)
    alive = np.flatnonzero(size - spaces > 0)
    ws, we, _ = C.words(data, offsets)
    a, b = np.searchsorted(ws, starts[alive]), np.searchsorted(ws, ends[alive])
    n_words = np.maximum(b - a, 1).astype(float)
    length = we - ws
    run_length = np.concatenate(([0], np.cumsum(length)))
    print_ = length | data[ws].astype(np.int64) << 32 | data[we - 1].astype(np.int64) << 40 | data[(ws + we) // 2].astype(np.int64) << 48 if len(ws) else np.zeros(0, np.int64)

    def share(flag: np.ndarray, skip: int = 0) -> np.ndarray:
        run = np.concatenate(([0], np.cumsum(flag)))
        return np.where(b - a > skip, run[b] - run[np.minimum(a + skip, b)], 0) / n_words

    def lag(k: int) -> np.ndarray:
        flag = np.zeros(len(ws), bool)
        if len(ws) > k:
            flag[k:] = print_[k:] == print_[:-k]
        return share(flag, k)

    chars = np.maximum(size - more, 1)[alive]
    first, last = data[starts[alive]], data[ends[alive] - 1]
    upper_table = np.isin(np.arange(256), [*_UPPER])
    end_table = np.isin(np.arange(256), [*b".!?:;\"'"])
    x = np.stack([np.ones(len(alive)), letters[alive] / chars, upper[alive] / np.maximum(letters[alive], 1), digits[alive] / chars, spaces[alive] / chars, 4 * symbols[alive] / chars, 4 * bangs[alive] / chars, 4 * stops[alive] / chars, np.log1p(chars) / 6, np.minimum((run_length[b] - run_length[a]) / n_words, 30) / 10, share(length <= 3), lag(1), lag(2), end_table[last].astype(float), upper_table[first].astype(float)], axis=1)
    return x, size[alive], alive, per


@dataclass(frozen=True)
class Model:
    """weights: for boilerplate against content; trans[i][j]: from label i to j (0 content, 1 boilerplate); start: of label 1 at the first line."""

    weights: tuple[float, ...]
    trans: tuple[tuple[float, float], tuple[float, float]]
    start: float


#: Without labels of both classes there is nothing to learn from: every line is content.
NEUTRAL = Model((-1.0,) + (0.0,) * (len(FEATURES) - 1), ((0.0, 0.0), (0.0, 0.0)), 0.0)


def viterbi(score: list[float], model: Model) -> list[int]:
    """Best labels of one chain, where score is that of label 1 against label 0. On a tie content wins."""
    (t00, t01), (t10, t11) = model.trans
    c, b = 0.0, model.start + score[0] if score else 0.0
    back = []
    for s in score[1:]:
        cc, cb = c + t00, b + t10
        bc, bb = c + t01, b + t11
        back.append((cb > cc, bb > bc))
        c, b = (cb if cb > cc else cc), (bb if bb > bc else bc) + s
    out = [int(b > c)] if score else []
    for step in reversed(back):
        out.append(int(step[out[-1]]))
    return out[::-1]


def log_likelihood(score: np.ndarray, label: np.ndarray, mask: np.ndarray, trans: np.ndarray, start: float) -> tuple[float, np.ndarray, np.ndarray, float]:
    """Of padded chains, with its gradients by score, trans and start (forward-backward)."""
    n, t = score.shape
    unary = np.stack([np.zeros_like(score), score], axis=2)
    alpha, beta = np.zeros((t, n, 2)), np.zeros((t, n, 2))
    alpha[0] = unary[:, 0] + np.array([0.0, start])
    for i in range(1, t):
        step = np.logaddexp(alpha[i - 1, :, :1] + trans[0], alpha[i - 1, :, 1:] + trans[1]) + unary[:, i]
        alpha[i] = np.where(mask[:, i, None], step, alpha[i - 1])
    z = np.logaddexp(alpha[-1, :, 0], alpha[-1, :, 1])
    for i in range(t - 2, -1, -1):
        after = beta[i + 1] + unary[:, i + 1]
        step = np.logaddexp(trans[:, 0] + after[:, :1], trans[:, 1] + after[:, 1:])
        beta[i] = np.where(mask[:, i + 1, None], step, beta[i + 1])
    p = np.exp(alpha + beta - z[None, :, None])
    g_score = np.where(mask, label - p[:, :, 1].T, 0.0)
    g_trans, value = np.zeros((2, 2)), -z.sum() + (score * label * mask).sum() + start * label[:, 0].sum()
    for i in range(1, t):
        m = mask[:, i]
        joint = np.exp(alpha[i - 1, :, :, None] + trans[None] + (beta[i] + unary[:, i])[:, None, :] - z[:, None, None])[m].sum(0)
        seen = np.zeros((2, 2))
        np.add.at(seen, (label[m, i - 1].astype(int), label[m, i].astype(int)), 1.0)
        g_trans += seen - joint
        value += (seen * trans).sum()
    return value, g_score, g_trans, float((label[:, 0] - p[0, :, 1]).sum())


def fit(texts: list[str | None], quality: list[int], rounds: int = 200, l2: float = 1e-5) -> Model:
    """Fits the field. Only documents carry labels, so first a logistic regression of lines on their documents' labels finds the lines of low-quality documents that look like content; these are relabelled before the chain is fitted."""
    if len(set(quality)) < 2:
        return NEUTRAL
    x, size, alive, per = features(*C.utf8(pa.array(texts, pa.string())))
    doc = np.repeat(np.arange(len(per)), per)[alive]
    y = 1.0 - np.array(quality, float)[doc]
    w = np.zeros(x.shape[1])
    weight = size**0.5
    weight = np.where(y > 0, weight / max(weight[y > 0].sum(), 1), weight / max(weight[y == 0].sum(), 1))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for i in range(1, 1001):
        g = x.T @ (weight * (y - 1 / (1 + np.exp(-x @ w)))) - l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w += 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    y = np.where((y > 0) & (x @ w > 0), 1.0, 0.0)
    # chains, padded
    first = np.concatenate(([True], doc[1:] != doc[:-1]))
    local = np.arange(len(doc)) - np.maximum.accumulate(np.where(first, np.arange(len(doc)), 0))
    chain = np.cumsum(first | (local % CHAIN == 0)) - 1
    at = local % CHAIN
    n, t = chain[-1] + 1, at.max() + 1
    label, mask = np.zeros((n, t)), np.zeros((n, t), bool)
    label[chain, at], mask[chain, at] = y, True
    trans, start = np.zeros((2, 2)), 0.0
    score = np.zeros((n, t))
    theta = np.concatenate((w, trans.reshape(-1), [start]))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, rounds + 1):
        w, trans, start = theta[:-5], theta[-5:-1].reshape(2, 2), theta[-1]
        score[chain, at] = x @ w
        _, gs, gt, g0 = log_likelihood(score, label, mask, trans, start)
        g = np.concatenate((x.T @ gs[chain, at], gt.reshape(-1), [g0])) / len(doc) - l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    trans = theta[-5:-1].reshape(2, 2)
    return Model(tuple(map(float, theta[:-5])), (tuple(map(float, trans[0])), tuple(map(float, trans[1]))), float(theta[-1]))


def train(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS, id_col: str = "doc_id", text: str = "text") -> Model:
    """Fits on at most per_class labelled documents of quality 0 and as many of quality 1. Rows with a null id, quality or text are left out; of the texts of one id the least is taken."""
    known = labels.where(f"{id_col} is not null and quality in (0, 1)").groupBy(id_col).agg(F.min("quality").alias("q"))
    parts = [known.where(f"q = {q}").orderBy(F.xxhash64(F.lit(11), id_col), id_col).limit(per_class) for q in (0, 1)]
    chosen = parts[0].unionByName(parts[1]).select(F.col(id_col).alias("k"), "q")  # at most 2 * per_class rows of two numbers, whatever the input
    rows = docs.select(F.col(id_col).alias("k"), F.col(text).alias("t")).where("t is not null").join(F.broadcast(chosen), "k").groupBy("k").agg(F.min("t").alias("t"), F.min("q").alias("q")).orderBy("k").collect()
    return fit([r.t for r in rows], [r.q for r in rows])


def decode(column: pa.Array, model: Model) -> pa.Array:
    data, offsets = C.utf8(column)
    w = np.array(model.weights)
    labels: list[str] = []
    shares: list[float | None] = []
    for a, b in C.pieces(offsets):
        x, size, alive, per = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        score = (x @ w).tolist()
        doc_end = np.searchsorted(alive, np.cumsum(per)).tolist()
        at = 0
        for end in doc_end:
            path = viterbi(score[at:end], model)
            total = float(size[at:end].sum())
            content = total - float((size[at:end] * path).sum())
            labels.append("".join("CB"[x] for x in path))
            shares.append(content / total if total else None)
            at = end
    return pa.StructArray.from_arrays([pa.array(labels, pa.string()), pa.array(shares, pa.float64())], ["line_labels", "content_share"])


def label_lines(docs: DataFrame, model: Model, text: str = "text", into: str = "quality_lines") -> DataFrame:
    """docs with a struct column `into`: line_labels, a letter C or B for each line that isn't blank, and content_share.

    Null, empty and blank texts have no labels and a null share. Whole texts are decoded, however long.
    """

    @F.arrow_udf("line_labels string, content_share double")
    def run(column: pa.Array) -> pa.Array:
        return decode(column, model)

    return docs.withColumn(into, run.asNondeterministic()(F.col(text)))  # as such it is evaluated once, not again in a filter


def quality_rules(docs: DataFrame, model: Model, min_share: float = MIN_SHARE, text: str = "text", keep_scores: bool = False) -> DataFrame:
    """The documents whose content share is at least min_share, with their columns; with keep_scores also line_labels and content_share.

    A document without any line that isn't blank has no content and goes, as do null texts. Repeated rows are decided alike, an
    empty table stays empty, and columns of any other names pass through unchanged (line_labels and content_share excepted, where
    keep_scores asks for them).
    """
    own = C.free_name(docs, "quality_lines")
    kept = label_lines(docs, model, text, own).where(F.col(own)["content_share"] >= min_share)
    if keep_scores:
        kept = kept.withColumns({"line_labels": F.col(own)["line_labels"], "content_share": F.col(own)["content_share"]})
    return kept.drop(own)
