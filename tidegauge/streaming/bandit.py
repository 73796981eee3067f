"""Epsilon-greedy choice of codecs, and its rewards."""

from __future__ import annotations

import json
import math
import random

RAW_BYTES = 80_000  # of a segment of 10,000 doubles

# Arms of lossless and lossy choice, in order.
LOSSLESS_ARMS = ("buff", "sprintz", "snappy", "gorilla", "gzip", "zlib1", "zlib2", "zlib5", "zlib7", "zlib9")
LOSSY_ARMS = ("bufflossy", "paa", "fourier", "pla")
TASKS = ("ml", "max", "sum", "max_ml", "sum_ml", "speed_ml")


class Bandit:
    """Values by arm: averages, or with a step moving averages."""

    def __init__(self, arms: int, epsilon: float = 0.1, initial: float = 4.0, step: float | None = 0.3, seed: int = 0):
        self.values, self.counts = [initial] * arms, [0] * arms
        self.epsilon, self.step, self.random = epsilon, step, random.Random(seed)

    def best(self) -> int:
        return max(range(len(self.values)), key=lambda i: (self.values[i], -i))

    def choose(self) -> int:
        if self.random.random() < self.epsilon:
            return self.random.randrange(len(self.values))
        return self.best()

    def update(self, arm: int, reward: float) -> None:
        self.counts[arm] += 1
        rate = self.step if self.step is not None else 1 / self.counts[arm]
        self.values[arm] += rate * (reward - self.values[arm])

    def dump(self) -> str:
        """State as text, to be kept beside a checkpoint."""
        return json.dumps({"values": self.values, "counts": self.counts, "random": self.random.getstate()})

    def load(self, text: str) -> None:
        raw = json.loads(text)
        self.values, self.counts = raw["values"], raw["counts"]
        version, internal, gauss = raw["random"]
        self.random.setstate((version, tuple(internal), gauss))


def band(ratio: float) -> int:
    """Which of the three bandits a ratio belongs to."""
    return 0 if ratio >= 0.25 else 1 if ratio >= 0.125 else 2


def size_reward(n_bytes: int) -> float:
    return RAW_BYTES / n_bytes


def ml_reward(accuracy: float, ratio: float) -> float:
    return accuracy / (1 + ratio)


def aggregate_reward(relative_error: float) -> float:
    return 20.0 if relative_error == 0 else -math.log10(abs(relative_error))


def aggregate_ml_reward(accuracy: float, relative_error: float) -> float:
    return 10 * accuracy + 0.3 * aggregate_reward(relative_error)


def speed_ml_reward(accuracy: float, throughput: float) -> float:
    return accuracy + 1.1 * throughput / 200_000


def reward(task: str, accuracy: float = 0.0, max_error: float = 0.0, sum_error: float = 0.0, ratio: float = 1.0, throughput: float = 0.0) -> float:
    """What a task pays for a segment's measures."""
    if task == "ml":
        return ml_reward(accuracy, ratio)
    if task in ("max", "sum"):
        return aggregate_reward(max_error if task == "max" else sum_error)
    if task in ("max_ml", "sum_ml"):
        return aggregate_ml_reward(accuracy, max_error if task == "max_ml" else sum_error)
    if task == "speed_ml":
        return speed_ml_reward(accuracy, throughput)
    raise ValueError(f"no task {task}")
