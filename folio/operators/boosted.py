"""Gradient-boosted trees from their published JSON, scored without the library that trained them.

A model's trees become flat arrays, one entry a node. All rows of a batch walk
a tree together, a level at a time: no row is handled by itself, and a batch
needs memory for its rows only. Features are 32-bit numbers as the format has
them; a missing one goes the way that its node says.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.errors import ModelError

#: What objectives make of a sum of leaves, and of a model's base score.
LOGISTIC = {"binary:logistic", "reg:logistic"}
EXPONENTIAL = {"count:poisson", "reg:gamma", "reg:tweedie", "survival:cox"}
SOFTMAX = {"multi:softprob", "multi:softmax"}
PLAIN = {"reg:squarederror", "reg:squaredlogerror", "reg:absoluteerror", "reg:pseudohubererror", "reg:linear", "binary:logitraw", "binary:hinge", "rank:pairwise", "rank:ndcg", "rank:map"}


@dataclass
class Tree:
    """A tree's nodes: children (-1 for a leaf), what is compared with what, where missing values go, and leaves' values."""

    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    value: np.ndarray  # of a leaf its score, else the number that smaller features go left of
    missing_left: np.ndarray
    categories: dict[int, np.ndarray]  # of a node that splits by category those that go right
    weight: float = 1.0

    @staticmethod
    def of(spec: dict, weight: float = 1.0) -> Tree:
        cats = {}
        held = spec.get("categories") or []
        for node, at, n in zip(spec.get("categories_nodes") or [], spec.get("categories_segments") or [], spec.get("categories_sizes") or [], strict=True):
            cats[int(node)] = np.array(held[at : at + n], np.int64)
        return Tree(
            np.array(spec["left_children"], np.int64),
            np.array(spec["right_children"], np.int64),
            np.array(spec["split_indices"], np.int64),
            np.array(spec["split_conditions"], np.float32),
            np.array(spec["default_left"], np.int64).astype(bool),
            cats,
            weight,
        )

    def leaves(self, features: np.ndarray) -> np.ndarray:
        """The leaf that each row (float32, missing as NaN) comes to."""
        at = np.zeros(len(features), np.int64)
        live = np.flatnonzero(self.left[at] >= 0)
        while len(live):
            node = at[live]
            x = features[live, self.feature[node]]
            missing = np.isnan(x)
            left = x < self.value[node]
            for n, right in self.categories.items():
                here = np.flatnonzero((node == n) & ~missing)
                # categories are whole numbers; what is none of those that go right goes left
                left[here] = (x[here] < 0) | ~np.isin(x[here].astype(np.int64), right)
            left = np.where(missing, self.missing_left[node], left)
            at[live] = np.where(left, self.left[node], self.right[node])
            live = live[self.left[at[live]] >= 0]
        return at

    def scores(self, features: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(features)] * np.float32(self.weight)

    def column(self, features: Sequence[Column], node: int = 0) -> Column:
        """The same as nested CASE, of a tree small enough to be one expression; null is missing."""
        if self.left[node] < 0:
            return F.lit(float(self.value[node] * np.float32(self.weight)))
        x = features[self.feature[node]].cast("float")
        to_left, to_right = (self.column(features, int(child[node])) for child in (self.left, self.right))
        missing = x.isNull() | F.isnan(x)
        left = ~x.isin([float(c) for c in self.categories[node]]) if node in self.categories else x < F.lit(float(self.value[node])).cast("float")
        return F.when(missing, to_left if self.missing_left[node] else to_right).when(left, to_left).otherwise(to_right)


class Booster:
    """A booster of trees ('gbtree' or 'dart') in the JSON form that its library saves.

    ``predict`` gives a value a row, or one for each class; ``predict_proba``
    one for each class, also of two. Columns of pandas categories count by
    their codes, others as numbers.
    """

    def __init__(self, body: bytes) -> None:
        try:
            learner = json.loads(body)["learner"]
            given = learner["learner_model_param"]
            booster = learner["gradient_booster"]
            kind = booster.get("name", "gbtree")
            if kind == "dart":
                weights, booster = [float(w) for w in booster["weight_drop"]], booster["gbtree"]
            model = booster["model"] if kind in ("gbtree", "dart") else None
        except (KeyError, TypeError, ValueError) as err:
            raise ModelError(f"no booster's JSON: {type(err).__name__} {err}") from err
        if model is None:
            raise ModelError(f"a booster of the kind {kind} has no trees")
        self.objective = learner["objective"]["name"]
        if self.objective not in LOGISTIC | EXPONENTIAL | SOFTMAX | PLAIN:
            raise ModelError(f"unknown objective {self.objective}")
        self.classes = max(1, int(given.get("num_class", "0")))
        self.group = np.array(model["tree_info"], np.int64)
        self.trees = [Tree.of(t, weights[k] if kind == "dart" else 1.0) for k, t in enumerate(model["trees"])]
        self.n_features = int(given["num_feature"])
        self.names = learner.get("feature_names") or []
        base = np.array([float(x) for x in str(given["base_score"]).strip("[]").split(",")], np.float32)
        self.base = np.broadcast_to(self._margin(base), (self.classes,)).astype(np.float32)

    def _margin(self, base: np.ndarray) -> np.ndarray:
        """A base score is kept as the prediction that it is; sums begin at what gives it."""
        if self.objective in LOGISTIC:
            return -np.log(np.float32(1) / base - np.float32(1))
        return np.log(base) if self.objective in EXPONENTIAL else base

    def features(self, frame: pd.DataFrame) -> np.ndarray:
        """The columns as 32-bit numbers, in the model's order where it names them."""
        named = self.names and set(self.names) <= set(frame.columns)
        columns = [frame[c] for c in (self.names if named else frame.columns)]
        if len(columns) != self.n_features:
            raise ModelError(f"the model takes {self.n_features} features, not {len(columns)}")
        out = np.empty((len(frame), len(columns)), np.float32)
        for k, c in enumerate(columns):
            if isinstance(c.dtype, pd.CategoricalDtype):
                codes = c.cat.codes.to_numpy()
                out[:, k] = np.where(codes < 0, np.nan, codes)
            else:
                out[:, k] = pd.to_numeric(c, errors="raise").astype("float64").to_numpy()
        return out

    def margins(self, frame: pd.DataFrame) -> np.ndarray:
        """Sums of leaves by row and class, added in the order of the trees."""
        x = self.features(frame)
        total = np.repeat(self.base[None, :], len(x), axis=0)
        for group, tree in zip(self.group.tolist(), self.trees, strict=True):
            total[:, group] += tree.scores(x)
        return total

    def predict(self, frame: pd.DataFrame) -> Any:
        m = self.margins(frame)
        if self.objective in SOFTMAX:
            p = _softmax(m)
            return p.argmax(axis=1).astype(np.float32) if self.objective == "multi:softmax" else p
        m = m[:, 0] if self.classes == 1 else m
        if self.objective in LOGISTIC:
            return _logistic(m)
        if self.objective == "binary:hinge":
            return (m > 0).astype(np.float32)
        return np.exp(m) if self.objective in EXPONENTIAL else m

    def predict_proba(self, frame: pd.DataFrame) -> np.ndarray:
        m = self.margins(frame)
        if self.objective in SOFTMAX:
            return _softmax(m)
        p = _logistic(m[:, 0]) if self.objective in LOGISTIC or self.objective == "binary:logitraw" else m[:, 0]
        return np.stack([1 - p, p], axis=1)

    def column(self, features: Sequence[Column]) -> Column:
        """The prediction of a booster of one value as an expression, for few small trees: it stays in the plan's generated code."""
        if self.classes > 1:
            raise ModelError("of several classes there is no single column")
        total = F.lit(float(self.base[0]))
        for tree in self.trees:
            total = total + tree.column(features)
        return 1 / (1 + F.exp(-total)) if self.objective in LOGISTIC else F.exp(total) if self.objective in EXPONENTIAL else total


def _logistic(m: np.ndarray) -> np.ndarray:
    return np.float32(1) / (np.float32(1) + np.exp(-m))


def _softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def saved_tree(node: dict | float) -> dict:
    """A nested tree as the format has it: {'feature', 'below' or 'right_if', 'missing', 'yes', 'no'} or a leaf's value.

    Features below ``below`` go to 'yes', categories in ``right_if`` to 'no',
    missing ones to the side that ``missing`` names.
    """
    nodes: list[dict] = []

    def add(n: dict | float) -> int:
        at = len(nodes)
        nodes.append({})
        if isinstance(n, dict):
            yes, no = add(n["yes"]), add(n["no"])
            nodes[at] = {"left": yes, "right": no, "feature": n["feature"], "value": n.get("below", 0.0), "missing": n.get("missing", "yes") == "yes", "cats": sorted(n.get("right_if", ()))}
        else:
            nodes[at] = {"left": -1, "right": -1, "feature": 0, "value": n, "missing": False, "cats": []}
        return at

    add(node)
    split = [(k, n["cats"]) for k, n in enumerate(nodes) if n["cats"]]
    sizes = [len(c) for _, c in split]
    return {
        "left_children": [n["left"] for n in nodes],
        "right_children": [n["right"] for n in nodes],
        "split_indices": [n["feature"] for n in nodes],
        "split_conditions": [n["value"] for n in nodes],
        "default_left": [int(n["missing"]) for n in nodes],
        "split_type": [int(bool(n["cats"])) for n in nodes],
        "categories": [c for _, cats in split for c in cats],
        "categories_nodes": [k for k, _ in split],
        "categories_segments": [sum(sizes[:i]) for i in range(len(sizes))],
        "categories_sizes": sizes,
    }


def saved_booster(trees: Sequence[dict | float], n_features: int, objective: str = "binary:logistic", base_score: float = 0.5, classes: int = 0, groups: Sequence[int] | None = None, names: Sequence[str] = (), weights: Sequence[float] | None = None) -> bytes:
    """A booster of nested trees (see ``saved_tree``) as its JSON; ``weights`` make it one of the kind 'dart'."""
    model = {"model": {"trees": [saved_tree(t) for t in trees], "tree_info": list(groups or [0] * len(trees))}, "name": "gbtree"}
    if weights is not None:
        model = {"name": "dart", "gbtree": model, "weight_drop": list(weights)}
    given = {"base_score": repr(base_score), "num_class": str(classes), "num_feature": str(n_features)}
    return json.dumps({"learner": {"feature_names": list(names), "gradient_booster": model, "learner_model_param": given, "objective": {"name": objective}}}).encode()
