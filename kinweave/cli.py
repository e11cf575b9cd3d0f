"""Command line: run a linkage, or one stage of it."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from kinweave.plans.pipeline import STAGES, LinkagePipeline


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kinweave", description=__doc__)
    p.add_argument("--config-file", required=True, help="YAML with data files, variables and parameters; a stored config.yaml resumes a run")
    p.add_argument("--output-dir", default="kinweave_output")
    p.add_argument("--constraints-file", help="Python file that defines CONSTRAINTS")
    p.add_argument("--models", help="directory of models of an earlier run")
    p.add_argument("--master", default=None)
    p.add_argument("--force", action="store_true", help="run stages again whose outputs are there")
    p.add_argument("stage", choices=("run", *STAGES), help="'run' for all stages")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    builder = SparkSession.builder.appName("kinweave")
    spark = (builder.master(a.master) if a.master else builder).getOrCreate()
    pipeline = LinkagePipeline(spark, a.config_file, a.output_dir, a.constraints_file, a.models)
    if a.stage == "run":
        pipeline.run(a.force)
    else:
        pipeline.run(until=a.stage) if not a.force else pipeline.run_stage(a.stage, force=True)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
