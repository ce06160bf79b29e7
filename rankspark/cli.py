"""Commands: one task, or a grid of models and domains.

    python -m rankspark.cli task --task text_text --model bm25 --domains biology law --documents D --examples E --output O
    python -m rankspark.cli grid --tasks text_text text_pair --domains biology --dry-run
"""

from __future__ import annotations

import argparse
import json

from rankspark.operators import profiles


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="rankspark")
    kinds = top.add_subparsers(dest="command", required=True)
    for name in ("task", "grid"):
        p = kinds.add_parser(name)
        p.add_argument("--domains", nargs="+", required=True)
        for path in ("--documents", "--examples", "--document-images", "--query-images", "--cache"):
            p.add_argument(path)
        p.add_argument("--output", default="outputs")
        p.add_argument("--configs", default="configs")
        p.add_argument("--topk", type=int, default=1000)
        p.add_argument("--debug", action="store_true", help="30 documents and 10 queries")
        p.add_argument("--force", action="store_true", help="don't reuse runs")
        p.add_argument("--exclusion", choices=("before", "after", "mask", "none"))
    kinds.choices["task"].add_argument("--task", choices=profiles.TASKS, required=True)
    kinds.choices["task"].add_argument("--model", required=True)
    kinds.choices["grid"].add_argument("--tasks", nargs="+", choices=profiles.TASKS, default=list(profiles.TASKS))
    kinds.choices["grid"].add_argument("--models", nargs="*", help="all of each task, if none is named")
    kinds.choices["grid"].add_argument("--dry-run", action="store_true")
    return top


def planned(args: argparse.Namespace) -> list[tuple[str, str]]:
    """(task, model) in the order in which they run."""
    if args.command == "task":
        if args.model not in profiles.names(args.task):
            raise SystemExit(f"{args.task} has the models {', '.join(profiles.names(args.task))}")
        return [(args.task, args.model)]
    return [(t, m) for t in args.tasks for m in profiles.names(t) if not args.models or m in args.models]


def main(argv: list[str] | None = None) -> list[dict]:
    args = parser().parse_args(argv)
    runs = planned(args)
    if args.command == "grid" and args.dry_run:
        for task, model in runs:
            print(task, model, *args.domains)
        return []
    from rankspark.plans.runner import Settings, run
    from rankspark.session import session

    spark, out = session(), []
    for task, model in runs:
        settings = Settings(task, model, tuple(args.domains), args.documents, args.examples, args.output, args.document_images, args.query_images, args.configs, args.cache, args.topk, args.debug, args.force, args.exclusion)
        try:
            out.append(run(spark, settings))
            print(json.dumps(out[-1]["aggregated"]))
        except Exception as error:  # one model's failure doesn't end a grid
            if args.command == "task":
                raise
            print(f"{task} {model}: {error}")
    return out


if __name__ == "__main__":
    main()
