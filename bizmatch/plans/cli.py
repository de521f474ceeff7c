"""Command lines: `python -m bizmatch.plans.cli pipeline ...` and `... optimize ...`."""

from __future__ import annotations

import argparse

from ..session import get_spark, ship
from .resolve import run_optimizer, run_pipeline


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="bizmatch")
    commands = top.add_subparsers(dest="command", required=True)
    flag = {"action": "store_true"}
    p = commands.add_parser("pipeline", help="records to candidates and matches")
    p.add_argument("--data_dir", required=True)
    p.add_argument("--is_train", **flag)
    p.add_argument("--validate", **flag)
    p.add_argument("--candidate_out", default="candidate_pairs.tsv")
    p.add_argument("--matching_out", default="matching_results.tsv")
    p.add_argument("--model_path", default="models/entity_model")
    p.add_argument("--batch_size", type=int, default=50_000, help="kept for scripts; partitions take its place")
    p.add_argument("--top_k", type=int, default=30)
    p.add_argument("--threshold", type=float, default=0.80)
    o = commands.add_parser("optimize", help="candidates to matches at a tuned threshold")
    o.add_argument("--data_dir", required=True)
    o.add_argument("--candidates", default="candidate_pairs.tsv")
    o.add_argument("--output", default="matching_results.tsv")
    o.add_argument("--model_path", default="models/entity_model")
    o.add_argument("--is_train", **flag)
    o.add_argument("--validate", **flag)
    o.add_argument("--train", **flag)
    o.add_argument("--threshold", type=float, default=0.62)
    o.add_argument("--batch_size", type=int, default=100_000, help="kept for scripts; partitions take its place")
    o.add_argument("--no_candidates", **flag)
    for c in (p, o):
        c.add_argument("--max_s2", type=int, default=5)
        c.add_argument("--max_s3", type=int, default=6)
        c.add_argument("--subset", type=int, default=0)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = get_spark(f"bizmatch-{args.command}")
    ship(spark)
    (run_pipeline if args.command == "pipeline" else run_optimizer)(spark, args).show(truncate=False)


if __name__ == "__main__":
    main()
