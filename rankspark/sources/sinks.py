"""Sinks: runs, metrics and summaries."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder prefixes of the four tasks.
TASKS = {"text_text": "run", "multimodal_text": "multimodal", "text_image": "multimodal_it2i", "text_pair": "it2it"}


def run_folder(root: str, task: str, model: str) -> str:
    """Where a task's run of a model goes; every task has its own prefix."""
    return f"{root.rstrip('/')}/{TASKS[task]}_{model}"


def write_run(run: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows of a run, in a folder for each model and domain."""
    run.write.mode(mode).partitionBy("model", "domain").parquet(path)


def run_as_json(run: DataFrame) -> DataFrame:
    """(domain, query_id, scores): each query's documents and scores as one JSON object, in rank order.

    A query's list is bounded by the run's k.
    """
    ranked = F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score")))
    entries = F.transform(ranked, lambda x: F.struct(x["doc_id"], x["score"]))
    return run.groupBy("domain", "query_id").agg(F.to_json(F.map_from_entries(entries)).alias("scores"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").partitionBy("domain").json(path)


def write_summary(summary: DataFrame, model: str, task: str, path: str) -> dict:
    """summary: (domain, metric, value), domain null for the mean over domains. A few numbers for each domain."""
    out: dict = {"model": model, "task_type": task, "domains": {}, "aggregated": {}}
    for r in summary.collect():
        target = out["aggregated"] if r["domain"] is None else out["domains"].setdefault(r["domain"], {})
        target[r["metric"]] = r["value"]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(out, indent=2))
    return out
