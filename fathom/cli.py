"""Command line: train, tune, evaluate, predict, generate-data, preprocess, version."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from fathom import __version__
from fathom.config import Settings
from fathom.errors import FathomError
from fathom.pipeline import ForecastPipeline
from fathom.sources import ledger, sinks


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="fathom", description="Forecasts from sales ledgers, on Spark.")
    out.add_argument("--log-level", default=None, choices=["DEBUG", "INFO", "WARNING", "ERROR"])
    steps = out.add_subparsers(dest="command", required=True)

    def step(name: str, says: str, *flags: tuple) -> None:
        one = steps.add_parser(name, help=says)
        for flag, options in flags:
            one.add_argument(flag, **options)

    cost = ("--run-metrics", {"help": "what each step has cost, as CSV"})
    data, config, output = ("--data", {"required": True}), ("--config", {"help": "settings as YAML"}), ("--output", {"required": True})
    model = ("--model", {"required": True, "help": "folder of a saved model"})
    step("train", "fit and save a model", data, config, output, cost)
    step("tune", "train many settings of the linear model, most of them not to the end; a table of trials and the best model", data, config, output, cost)
    step("evaluate", "errors on the last windows of a ledger", data, model, ("--output", {"help": "JSON file"}), cost)
    step("predict", "forecasts as CSV", data, model, output, ("--confidence", {"type": float, "default": 0.95}))
    counts = [(f"--{n}", {"type": int, "default": d}) for n, d in (("days", 1460), ("products", 100), ("stores", 20), ("seed", 42))]
    step("generate-data", "a synthetic ledger as CSV", output, *counts)
    step("preprocess", "load, resample and filter; Parquet", data, config, output)
    step("version", "what this is")
    return out


def _settings(path: str | None) -> Settings:
    return (Settings.from_yaml(path) if path else Settings()).with_environment()


def _cost(done: ForecastPipeline, path: str | None) -> None:
    if path:
        sinks.write_csv(done.run_metrics().coalesce(1), path)


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    if args.command == "train":
        done = ForecastPipeline(spark, _settings(args.config)).load_and_preprocess(args.data).create_datasets().train()
        done.save(args.output)
        print(sinks.metrics_json(done.evaluate()))
        _cost(done, args.run_metrics)
    elif args.command == "tune":
        done = ForecastPipeline(spark, _settings(args.config)).load_and_preprocess(args.data).create_datasets()
        trials = done.tune(f"{args.output}/study")
        sinks.write_csv(trials, f"{args.output}/trials.csv")
        done.save(f"{args.output}/model")
        print(sinks.metrics_json(done.evaluate()))
        _cost(done, args.run_metrics)
    elif args.command == "evaluate":
        done = ForecastPipeline.load(spark, args.model).restore(args.data)
        metrics = done.evaluate()
        print(sinks.metrics_json(metrics))
        if args.output:
            sinks.write_metrics(metrics, args.output)
        _cost(done, args.run_metrics)
    elif args.command == "predict":
        sinks.write_csv(ForecastPipeline.load(spark, args.model).restore(args.data).predict(args.confidence).drop("y", "yhat"), args.output)
    elif args.command == "generate-data":
        sinks.write_csv(ledger.sorted_by_date(ledger.generate_sales(spark, args.days, args.products, args.stores, seed=args.seed)), args.output)
    elif args.command == "preprocess":
        pipeline = ForecastPipeline(spark, _settings(args.config))
        sinks.write_parquet(pipeline.prepared(pipeline.read(args.data)), args.output)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(f"fathom {__version__}")
        return 0
    level = args.log_level or Settings().with_environment().log_level
    logging.basicConfig(level=level, format="%(asctime)s %(name)s %(levelname)s %(message)s")
    try:
        session = spark or SparkSession.builder.appName("fathom").getOrCreate()
        session.sparkContext.setLogLevel("WARN" if level == "WARNING" else level)
        return run(args, session)
    except FathomError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
