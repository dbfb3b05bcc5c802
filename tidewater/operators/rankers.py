"""Second-stage rankers: a score from the 19 features, as a column of float."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.errors import InvalidArgument
from tidewater.functions.features import COUNT


class Ranker(ABC):
    name = ""

    @abstractmethod
    def score(self, features: list[Column]) -> Column: ...

    @abstractmethod
    def to_json(self) -> str: ...


class Bm25Ranker(Ranker):
    name = "bm25"

    def score(self, features: list[Column]) -> Column:
        return features[0].cast("float")

    def to_json(self) -> str:
        return json.dumps({"type": self.name})


class LinearRanker(Ranker):
    name = "linear"

    def __init__(self, weights: list[float], bias: float = 0.0):
        if len(weights) != COUNT:
            raise InvalidArgument(f"weights must have {COUNT} entries")
        self.weights, self.bias = [float(w) for w in weights], float(bias)

    def score(self, features: list[Column]) -> Column:
        total = F.lit(self.bias)
        for w, f in zip(self.weights, features):
            total = total + F.lit(w) * f.cast("double")
        return total.cast("float")

    def to_json(self) -> str:
        return json.dumps({"type": self.name, "weights": self.weights, "bias": self.bias})

    @staticmethod
    def from_json(text: str) -> LinearRanker:
        try:
            raw = json.loads(text)
        except ValueError as e:
            raise InvalidArgument(f"not JSON: {e}") from e
        number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
        if not isinstance(raw, dict) or not isinstance(raw.get("weights"), list) or not all(map(number, raw["weights"])):
            raise InvalidArgument("weights must be a list of numbers")
        bias = raw.get("bias", 0.0)
        return LinearRanker(raw["weights"], bias if number(bias) else 0.0)


class ModelRanker(Ranker):
    """A learned model: a function from an (n, 19) array to n scores, in batches. Without one the first feature is the score."""

    name = "catboost"

    def __init__(self, model: Callable[[np.ndarray], np.ndarray] | None = None):
        self.model = model

    def score(self, features: list[Column]) -> Column:
        if self.model is None:
            return features[0].cast("float")
        model = self.model

        @F.pandas_udf("float")
        def run(x: pd.Series) -> pd.Series:
            return pd.Series(np.asarray(model(np.stack(x.to_numpy())), np.float32)) if len(x) else pd.Series([], dtype="float32")

        return run(F.array(*(f.cast("double") for f in features)))

    def to_json(self) -> str:
        return json.dumps({"type": self.name})


class ObliviousTrees:
    """Sum of oblivious trees: each level asks one feature > border, the answers are the bits of the leaf's number, first level lowest. Made from {"trees": [{"splits": [[feature, border], ...], "leaves": [...]}], "bias": x}."""

    def __init__(self, model: dict):
        self.trees = [([(int(f), float(b)) for f, b in t["splits"]], np.array(t["leaves"], float)) for t in model["trees"]]
        self.bias = float(model.get("bias", 0.0))
        if any(len(leaves) != 1 << len(splits) for splits, leaves in self.trees):
            raise InvalidArgument("a tree needs 2 ** depth leaves")

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for splits, leaves in self.trees:
            at = np.zeros(len(x), np.int64)
            for level, (f, border) in enumerate(splits):
                at |= (x[:, f] > border).astype(np.int64) << level
            out += leaves[at]
        return out


def _pairs(label: np.ndarray, query: list) -> tuple[np.ndarray, np.ndarray]:
    """(better, worse): the places of all pairs of one query and different labels."""
    groups: dict = {}
    for i, q in enumerate(query):
        groups.setdefault(q, []).append(i)
    found = []
    for g in map(np.array, groups.values()):
        i, j = np.nonzero(label[g][:, None] > label[g][None, :])
        found.append((g[i], g[j]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def train_linear(rows: list[tuple[float, object, list[float]]], rounds: int = 300, rate: float = 0.05) -> LinearRanker:
    """Fits a linear ranker on a pool of (label, query id, features), pairs of one query and different labels, by logistic loss. The pool is what judges have labelled, so it is small."""
    x = np.array([r[2] for r in rows], float).reshape(-1, COUNT)
    label = np.array([r[0] for r in rows], float)
    scale = np.maximum(np.abs(x).max(0, initial=0.0), 1e-9)
    better, worse = _pairs(label, [r[1] for r in rows])
    w = np.zeros(COUNT)
    if len(better):
        diff = (x[better] - x[worse]) / scale
        gain = 2.0 ** label[better] - 2.0 ** label[worse]
        for _ in range(rounds):
            w += rate * ((gain / (1 + np.exp(np.clip(diff @ w, -50, 50)))) @ diff / gain.sum() - 1e-3 * w)
    return LinearRanker(list(w / scale))


def train_trees(rows: list[tuple[float, object, list[float]]], trees: int = 100, depth: int = 4, rate: float = 0.1, borders: int = 32, l2: float = 1.0) -> dict:
    """Fits oblivious trees on a pool of (label, query id, features) by boosting the logistic loss of pairs of one query; the model as ObliviousTrees takes it. Labels weigh pairs as in train_linear. Without pairs there are no trees."""
    x = np.array([r[2] for r in rows], float).reshape(-1, COUNT)
    label = np.array([r[0] for r in rows], float)
    better, worse = _pairs(label, [r[1] for r in rows])
    model: dict = {"trees": [], "bias": 0.0}
    if not len(better):
        return model
    gain = 2.0 ** label[better] - 2.0 ** label[worse]
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, borders + 2)[1:-1])) for f in range(COUNT)]
    options = [(f, float(b)) for f in range(COUNT) for b in cuts[f] if (x[:, f] > b).any()]
    over = np.stack([x[:, f] > b for f, b in options]) if options else np.zeros((0, len(x)), bool)
    score = np.zeros(len(x))
    for _ in range(trees if len(options) else 0):
        p = 1 / (1 + np.exp(np.clip(score[better] - score[worse], -50, 50)))
        n = len(x)
        grad = np.bincount(better, gain * p, n) - np.bincount(worse, gain * p, n)
        hess = np.bincount(better, gain * p * (1 - p), n) + np.bincount(worse, gain * p * (1 - p), n)
        leaf, splits = np.zeros(n, np.int64), []
        for level in range(depth):
            at = leaf[None, :] | (over.astype(np.int64) << level)
            size = 2 << level
            worth = np.array([(np.bincount(a, grad, size) ** 2 / (np.bincount(a, hess, size) + l2)).sum() for a in at])
            best = int(worth.argmax())
            splits.append(list(options[best]))
            leaf = at[best]
        values = rate * np.bincount(leaf, grad, 1 << depth) / (np.bincount(leaf, hess, 1 << depth) + l2)
        model["trees"].append({"splits": splits, "leaves": values.tolist()})
        score += values[leaf]
    return model
