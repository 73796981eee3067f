"""Models as JSON text, for what is not a Spark model."""

from __future__ import annotations

import json

import numpy as np

from .linear import Linear
from .models import IsolationForest


def dump(model: Linear | IsolationForest | np.ndarray) -> str:
    """Text of a linear model, an isolation forest or centroids."""
    if isinstance(model, Linear):
        return json.dumps({"kind": "linear", "features": model.features, "coefficients": list(map(float, model.coefficients)), "intercept": model.intercept})
    if isinstance(model, IsolationForest):
        return json.dumps({"kind": "isolation_forest", "trees": model.trees, "norm": model.norm})
    return json.dumps({"kind": "centroids", "rows": np.asarray(model, float).tolist()})


def load(text: str):
    raw = json.loads(text)
    if raw["kind"] == "linear":
        return Linear(raw["features"], np.array(raw["coefficients"]), raw["intercept"])
    if raw["kind"] == "isolation_forest":
        forest = IsolationForest()

        def node(t):
            return (int(t[0]), t[1], node(t[2]), node(t[3])) if isinstance(t, list) else t

        forest.trees, forest.norm = [node(t) for t in raw["trees"]], raw["norm"]
        return forest
    return np.array(raw["rows"])
