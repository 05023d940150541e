"""What an outside language model would need, with none attached: batches, budgets, a record of calls.

``Reader`` is the interface; ``disabled`` is the default and answers nothing, so every operator has a
deterministic path. A reader that fails to connect is disabled for the rest of the run."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CALLS = "run string, call int, name string, status string, attempts int, ms long"
TOKENS_MOST, TOKENS_GROWTH, TOKENS_MORE = 12_000, 1.8, 200

#: Parts of error texts.
CONNECTION = ["connection", "timeout", "timed out", "network", "dns", "unreachable", "refused"]
TOO_LONG = ["context length", "context window", "maximum context", "too many tokens", "context_length_exceeded"]


def batches(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """Adds batch: rows in order, ``size`` of them each. For tables as small as a profile."""
    return rows.withColumn("batch", F.floor((F.row_number().over(W.orderBy(*order)) - 1) / size).cast("int"))


def batch_budget(total: int, n_batches: int) -> int:
    return math.ceil(total / max(1, n_batches)) + 1


def error_kind(error: str) -> str:
    low = error.lower()
    return "too_long" if any(x in low for x in TOO_LONG) else "connection" if any(x in low for x in CONNECTION) else "other"


def truncated(answer: str) -> bool:
    """A JSON text that ends before it is whole."""
    try:
        json.loads(answer)
    except json.JSONDecodeError as e:
        return bool(answer.strip()) and (e.pos >= len(answer.rstrip()) - 1 or "Unterminated" in e.msg or answer.count("{") > answer.count("}") or answer.count("[") > answer.count("]"))
    return False


def strict_schema(schema: dict) -> dict:
    """A JSON schema with every property of every object required and no others allowed."""
    out = {k: strict_schema(v) if isinstance(v, dict) else [strict_schema(x) if isinstance(x, dict) else x for x in v] if isinstance(v, list) else v for k, v in schema.items()}
    if out.get("type") == "object" and isinstance(out.get("properties"), dict):
        out["required"], out["additionalProperties"] = list(out["properties"]), False
    return out


def disabled(prompt: str, tokens: int) -> str | None:
    return None


@dataclass
class Reader:
    """Asks ``answer`` (prompt, token limit) for JSON; None where it can't be had."""

    answer: Callable[[str, int], str | None] = disabled
    run: str = "run"
    attempts: int = 3
    calls: list[tuple] = field(default_factory=list)

    @property
    def enabled(self) -> bool:
        return self.answer is not disabled

    def ask(self, name: str, prompt: str, tokens: int = 1500):
        """The parsed answer. An empty one is asked for again, a cut one with more room."""
        status, tries, out = "disabled", 0, None
        while self.enabled and out is None and tries < self.attempts:
            tries += 1
            try:
                said = self.answer(prompt, tokens) or ""
                status = "empty" if not said.strip() else "truncated" if truncated(said) else "ok"
                if status == "truncated":
                    tokens = min(TOKENS_MOST, int(tokens * TOKENS_GROWTH) + TOKENS_MORE)
                elif status == "ok":
                    out = json.loads(said)
            except json.JSONDecodeError:
                status = "invalid"
            except Exception as e:  # noqa: BLE001  (whatever a client raises)
                status = error_kind(str(e))
                if status == "connection":
                    self.answer = disabled
                if status == "too_long":
                    break
        self.calls.append((self.run, len(self.calls) + 1, name, status, tries, 0))
        return out

    def ask_halves(self, name: str, rows: list, prompt: Callable[[list], str]) -> list:
        """Answers for ``rows``, halved as long as they are too many for one prompt."""
        said = self.ask(name, prompt(rows))
        if said is None and self.calls[-1][3] == "too_long" and len(rows) > 1:
            half = len(rows) // 2
            return self.ask_halves(name, rows[:half], prompt) + self.ask_halves(name, rows[half:], prompt)
        return [] if said is None else [said]

    def transcript(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.calls, CALLS)


def call_statistics(calls: DataFrame) -> DataFrame:
    """run, calls, errors, attempts."""
    bad = ~F.col("status").isin("ok", "disabled")
    return calls.groupBy("run").agg(F.count(F.lit(1)).alias("calls"), F.count_if(bad).alias("errors"), F.sum("attempts").alias("attempts"))
