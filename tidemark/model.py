"""The place of a labelling model: a backend protocol, an offline stand-in, and a bounded, retried map over comments."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.session import materialise

TRIES, FIRST_WAIT, LONGEST_WAIT = 3, 2.0, 10.0


class Backend(Protocol):
    def complete(self, system: str, user: str, temperature: float) -> str:
        """The model's answer to a prompt."""


class OfflineBackend:
    """Answers from the text alone, the same each time; for tests and dry runs."""

    def complete(self, system: str, user: str, temperature: float) -> str:
        k = sum(map(ord, user)) + int(temperature * 10)
        lab = lambda *x: x[k % len(x)]
        return json.dumps({
            "emotion": {"label": lab("positive", "neutral", "negative"), "confidence": 0.5 + k % 50 / 100}, "cooperative_principle": {"violated": k % 5 == 0, "maxim": "manner" if k % 5 == 0 else None},
            "interaction_type": {"label": lab("check_in", "expression", "other"), "confidence": 0.6}, "sentence_function": {"label": lab("declarative", "exclamatory", "fragment"), "confidence": 0.7},
            "orthography": {"status": lab("standard", "community_variant"), "confidence": 0.8}})


def extract_json(text: str | None) -> str | None:
    """The text if it is a JSON object, else the first balanced object in it, else None."""
    if not text:
        return None
    starts = [0] if text.lstrip().startswith("{") else []
    starts += [i for i, c in enumerate(text) if c == "{"]
    for s in starts:
        depth, quoted, escaped = 0, False, False
        for i in range(s, len(text)):
            c = text[i]
            if quoted:
                escaped, quoted = (c == "\\" and not escaped), not (c == '"' and not escaped)
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if depth == 0:
                    try:
                        return json.dumps(json.loads(text[s : i + 1]), ensure_ascii=False)
                    except ValueError:
                        break
    return None


def batch_items(answer: str | None, expected: int) -> list[str] | None:
    """The items of a batch answer; None unless there are as many as were asked for."""
    found = extract_json(answer)
    items = json.loads(found).get("items") if found else None
    return [json.dumps(x, ensure_ascii=False) for x in items] if isinstance(items, list) and len(items) == expected else None


def call(backend: Backend, system: str, user: str, temperature: float, wait=time.sleep) -> str | None:
    """An object from the model, tried three times with growing pauses; None if all fail."""
    pause = FIRST_WAIT
    for attempt in range(TRIES):
        try:
            if (found := extract_json(backend.complete(system, user, temperature))) is not None:
                return found
        except Exception:  # noqa: BLE001
            pass
        if attempt + 1 < TRIES:
            wait(min(pause, LONGEST_WAIT))
            pause *= 2
    return None


def label(samples: DataFrame, backend: Backend, system: str = "", text: str = "content", concurrency: int = 5, temperatures: tuple[float, float] = (0.2, 0.8)) -> DataFrame:
    """Adds raw answers ``raw_a`` and ``raw_b`` of two paths. Each task keeps a bounded number of calls open; the result is written once, so retried
    tasks of later stages never ask again."""
    schema = StructType([*samples.schema.fields, StructField("raw_a", StringType()), StructField("raw_b", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(concurrency) as pool:
            for b in batches:
                ask = lambda t, users=b[text]: list(pool.map(lambda u: call(backend, system, u, t), users))
                yield b.assign(raw_a=ask(temperatures[0]), raw_b=ask(temperatures[1]))

    return materialise(samples.mapInPandas(run, schema), "labels")
