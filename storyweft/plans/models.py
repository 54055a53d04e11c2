"""A step that asks an outside model, as a pluggable function, with an offline stub that is deterministic."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from storyweft.operators.store import cache_action

ANSWERS = "story_id long, status string, output_json string, error string"


def offline_titles(requests: list[dict]) -> list[str]:
    """Stands in for a model: the longest title, cut to 80 characters, as the answer's JSON."""
    return [json.dumps({"title": max(r["titles"], key=lambda t: (len(t), t), default="")[:80]}, ensure_ascii=False) for r in requests]


def model_answers(requests: DataFrame, call: Callable[[list[dict]], list[str]] = offline_titles, batch: int = 16, tries: int = 3) -> DataFrame:
    """requests(story_id, titles array<string>) -> story_id, status, output_json, error.

    `call` gets lists of at most `batch` requests on the executors and gives one JSON object each.  A call that raises is
    tried again, `tries` times in all; then, and where an answer is no JSON object, the status is ERROR.
    """

    def ask(some: list[dict]) -> list[tuple]:
        for k in range(tries):
            try:
                answers = call(some)
                break
            except Exception as e:  # noqa: BLE001  whatever the model's client raises is an error of these rows
                if k == tries - 1:
                    return [(r["story_id"], "ERROR", None, f"{type(e).__name__}: {e}") for r in some]
        out = []
        for r, text in zip(some, answers, strict=True):
            try:
                sound = isinstance(json.loads(text), dict)
            except (TypeError, ValueError):
                sound = False
            out.append((r["story_id"], "SUCCESS", text, None) if sound else (r["story_id"], "ERROR", None, "no JSON object"))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"story_id": int(i), "titles": [t for t in titles if t]} for i, titles in zip(b["story_id"], b["titles"], strict=True)]
            out = [x for lo in range(0, len(rows), batch) for x in ask(rows[lo : lo + batch])]
            yield pd.DataFrame(out, columns=["story_id", "status", "output_json", "error"])

    return requests.select("story_id", F.coalesce("titles", F.array().cast("array<string>")).alias("titles")).mapInPandas(run, ANSWERS)


def refreshed_titles(requests: DataFrame, cache: DataFrame, now, **options) -> DataFrame:
    """Answers for the requests whose cache row (story_id, status, updated_at) is missing, failed or out of date."""
    seen = requests.join(cache.select("story_id", "status", "updated_at"), "story_id", "left")
    due = seen.where(F.col("status").isNull() | cache_action(F.col("status"), F.col("updated_at"), now).isin("REFRESH", "USE_AND_REFRESH"))
    return model_answers(due.select("story_id", "titles"), **options)
