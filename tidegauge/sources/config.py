"""Ingestion settings from TOML."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from . import signals


@dataclass
class Client:
    """One producer: a file or a generator, with limits and pace."""

    id: int
    kind: str
    params: dict = field(default_factory=dict)
    amount: int | None = None
    interval: float | None = None
    run_period: float | None = None


@dataclass
class Config:
    segment_size: int
    buffer: dict
    runtime: dict
    clients: list[Client]


def parse(text: str) -> Config:
    """``interval`` and ``frequency`` both set the pace; a normal generator reads its
    mean from ``mean``.
    """
    raw = tomllib.loads(text)
    clients = []
    for i, (name, c) in enumerate(raw.get("clients", {}).items()):
        kind = c.get("type", "gen")
        kind = c.get("gen_type", "uniform") if kind == "gen" else kind
        amount = c.get("amount")
        amount = amount if isinstance(amount, int) else (int(amount) if str(amount).isdigit() else None)
        pace = c.get("interval", c.get("frequency"))
        clients.append(Client(int(c.get("id", i)), kind.lower(), {"name": name, **c.get("params", {})}, amount, float(pace) if pace else None, c.get("run_period")))
    return Config(int(raw["segment_size"]), raw.get("buffer", {}), raw.get("runtime", {}), clients)


def points(spark: SparkSession, client: Client, seed: int = 0) -> DataFrame:
    """Points of a client: signal_id, idx, value. Generators need an amount."""
    from pyspark.sql import functions as F

    p = client.params
    if client.kind == "normal":
        df = signals.normal_signal(spark, client.amount, float(p["mean"]), float(p["std"]), seed)
    elif client.kind == "uniform":
        df = signals.uniform_signal(spark, client.amount, float(p["low"]), float(p["high"]), seed)
    elif client.kind == "file":
        rows = signals.signal_csv(spark, p["path"], int(p.get("skip", 0)), p.get("delim", ","))
        df = signals.limited(signals.numbered(rows, ["line", "field"]).select("idx", "value"), client.amount)
    else:
        raise ValueError(f"no client kind {client.kind}")
    return df.select(F.lit(client.id).cast("long").alias("signal_id"), "idx", "value")
