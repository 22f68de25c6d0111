"""Assignment of new points to density-based clusters, from a fitted model's numbers.

A model is its core points with their core distances, the condensed tree that
they hang in, and the labels of the clusters that were chosen from it. A new
point takes the place in the tree of its neighbour by mutual reachability, as
high up as its own density allows. Rows come in batches and core points in
blocks, so that a task's memory is bounded by their product.
"""

from __future__ import annotations

import json
from typing import Any

import numpy as np
import pandas as pd

from folio.errors import ModelError

#: Core points whose distances to a batch are held at once.
BLOCK = 2_048
NOISE = -1


class DensityClusters:
    """``points``, their ``core_distances``, the tree's ``edges`` (parent, child, lambda; points are numbered from 0, clusters from their number on) and ``labels`` by cluster."""

    def __init__(self, points: Any, core_distances: Any, edges: Any, labels: dict[int, int], min_samples: int) -> None:
        self.points, self.core = np.asarray(points, np.float64), np.asarray(core_distances, np.float64)
        edges = np.asarray(edges, np.float64).reshape(-1, 3)
        n = len(self.points)
        if min_samples < 1 or n <= min_samples or len(self.core) != n or self.points.ndim != 2:
            raise ModelError("a density model has more points than min_samples, each with a core distance")
        size = int(edges[:, :2].max(initial=n)) + 1
        self.parent, self.birth = np.full(size, -1), np.zeros(size)
        self.parent[edges[:, 1].astype(np.int64)], self.birth[edges[:, 1].astype(np.int64)] = edges[:, 0].astype(np.int64), edges[:, 2]
        if (self.parent[:n] < n).any():
            raise ModelError("every point of a density model hangs in a cluster of its tree")
        self.root = int(edges[:, 0].min())
        self.min_samples = min_samples
        self.label = np.full(size, NOISE)
        for cluster, label in labels.items():
            self.label[int(cluster)] = label
        # how dense each chosen cluster gets: what strengths are relative to
        self.most = np.zeros(max([0, *(int(x) + 1 for x in labels.values())]))
        for child in range(n):
            label = self.label[self.parent[child]]
            if label != NOISE:
                self.most[label] = max(self.most[label], self.birth[child])

    @staticmethod
    def of_json(body: bytes) -> DensityClusters:
        try:
            spec = json.loads(body)
            return DensityClusters(spec["points"], spec["core_distances"], spec["edges"], {int(k): int(v) for k, v in spec["labels"].items()}, int(spec["min_samples"]))
        except (KeyError, TypeError, ValueError, UnicodeDecodeError) as err:
            raise ModelError(f"no density model's JSON (others need a loader): {type(err).__name__} {err}") from err

    def neighbours(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(points, distances) of the 2 min_samples nearest core points of each row, nearest first, equal ones by number."""
        k = min(2 * self.min_samples, len(self.points))
        best, far = np.zeros((len(rows), 0), np.int64), np.zeros((len(rows), 0))
        for at in range(0, len(self.points), BLOCK):
            block = self.points[at : at + BLOCK]
            apart = np.zeros((len(rows), len(block)))
            for d in range(block.shape[1]):  # a dimension at a time, so that no array has all of them
                apart += (rows[:, d, None] - block[None, :, d]) ** 2
            far = np.concatenate([far, np.sqrt(apart)], axis=1)
            best = np.concatenate([best, np.broadcast_to(np.arange(at, at + len(block)), (len(rows), len(block)))], axis=1)
            order = np.argsort(far, axis=1, kind="stable")[:, :k]
            best, far = np.take_along_axis(best, order, 1), np.take_along_axis(far, order, 1)
        return best, far

    def assigned(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(labels, strengths from 0 to 1) of rows of numbers; -1 is noise. A row with a missing number is noise."""
        rows = np.asarray(rows, np.float64)
        if rows.ndim != 2 or rows.shape[1] != self.points.shape[1]:
            raise ModelError(f"the model takes {self.points.shape[1]} columns")
        labels, strengths = np.full(len(rows), NOISE), np.zeros(len(rows))
        whole = np.flatnonzero(~np.isnan(rows).any(axis=1))
        if not len(whole):
            return labels, strengths
        near, far = self.neighbours(rows[whole])
        own = far[:, min(self.min_samples, far.shape[1] - 1), None]
        reach = np.maximum(np.maximum(self.core[near], own), far)
        nearest = reach.argmin(axis=1)
        take = np.arange(len(whole))
        neighbour, reach = near[take, nearest], reach[take, nearest]
        with np.errstate(divide="ignore"):
            density = np.where(reach > 0, 1 / reach, np.finfo(np.float64).max)
        cluster = self.parent[neighbour]
        climbs = self.birth[neighbour] > density
        while True:
            up = climbs & (cluster != self.root) & (self.birth[cluster] >= density)
            if not up.any():
                break
            cluster = np.where(up, self.parent[cluster], cluster)
        found = self.label[cluster]
        labels[whole] = found
        most = np.where(found == NOISE, 0.0, self.most[np.maximum(found, 0)]) if len(self.most) else np.zeros(len(found))
        strengths[whole] = np.where(found == NOISE, 0.0, np.where(most > 0, np.minimum(density, most) / np.where(most > 0, most, 1), 1.0))
        return labels, strengths

    def predict(self, frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return self.assigned(frame.astype("float64").to_numpy())


def core_distances(points: np.ndarray, min_samples: int) -> np.ndarray:
    """The distance of each point to its ``min_samples``-th neighbour, itself not counted: for models that are made here."""
    held = DensityClusters(points, np.zeros(len(points)), [[len(points), i, 1.0] for i in range(len(points))], {}, min_samples)
    return held.neighbours(np.asarray(points, np.float64))[1][:, min_samples]
