"""Command line: every option of RunConfig in snake_case and camelCase.

    python -m varsift.plans.cli --experiment_design_path design.tsv --count_path counts.tsv --wildtype_sequence ...
"""

from __future__ import annotations

import argparse
import logging
from dataclasses import MISSING, fields
from pathlib import Path

from varsift.plans.config import RunConfig

VERSION = "0.1.0"


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.capitalize() for x in rest)


def _kind(text: str):
    return int if text.startswith("int") else float if text.startswith("float") else Path if text.startswith("Path") else str


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="varsift", description="Variant counts and reads to fitness, on Spark.")
    for f in fields(RunConfig):
        names = [f"--{f.name}"] + ([f"--{_camel(f.name)}"] if _camel(f.name) != f.name else [])
        if f.type == "bool":
            out.add_argument(*names, dest=f.name, action=argparse.BooleanOptionalAction, default=f.default)
            out.add_argument(f"--no_{f.name}", dest=f.name, action="store_false", default=argparse.SUPPRESS)
        else:
            needed = f.default is MISSING and f.default_factory is MISSING
            default = None if needed else f.default if f.default is not MISSING else f.default_factory()
            out.add_argument(*names, dest=f.name, type=_kind(f.type), required=needed, default=default)
    out.add_argument("-v", "--verbose", action="store_true")
    out.add_argument("--version", action="version", version=VERSION)
    return out


def config_of(args: list[str] | None = None) -> tuple[RunConfig, bool]:
    given = vars(parser().parse_args(args))
    verbose = given.pop("verbose")
    return RunConfig(**given), verbose


def session(config: RunConfig):
    """The session that spark-submit describes; without one, num_cores threads of this machine."""
    from pyspark import SparkConf
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.appName(config.project_name)
    if not SparkConf().contains("spark.master"):
        builder = builder.config("spark.master", f"local[{config.num_cores}]").config("spark.sql.shuffle.partitions", max(2, config.num_cores))
    return builder.getOrCreate()


def main(args: list[str] | None = None) -> None:
    from varsift.plans.pipeline import run

    config, verbose = config_of(args)
    logging.basicConfig(level=logging.DEBUG if verbose else logging.INFO)
    run(session(config), config)


if __name__ == "__main__":
    main()
