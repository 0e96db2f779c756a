"""Command line: ``python -m stairwell.evaluate data.json predictions.json``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from stairwell.plans.evaluation import evaluate_v1, evaluate_v2, gold_table
from stairwell.sinks.writers import write_metrics
from stairwell.sources.maps import read_na_probabilities, read_predictions
from stairwell.sources.qa import read_squad


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Score predicted answers against gold answers.")
    parser.add_argument("data", help="nested question file")
    parser.add_argument("predictions", help="JSON object: question id to answer")
    parser.add_argument("-n", "--na-prob-file", help="JSON object: question id to no-answer probability")
    parser.add_argument("-t", "--na-prob-thresh", type=float, default=1.0, help="above it the answer is empty")
    parser.add_argument("-o", "--out-file", help="folder for the metrics; printed without it")
    parser.add_argument("--version", type=int, choices=(1, 2), default=2, help="scoring rules")
    parser.add_argument("--curves", action="store_true", help="add average precisions")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    options = arguments(argv)
    spark = SparkSession.builder.appName("evaluate").getOrCreate()
    golds = gold_table(read_squad(spark, options.data))
    predictions = read_predictions(spark, options.predictions)
    if options.version == 1:
        metrics = evaluate_v1(golds, predictions)
    else:
        chances = None
        if options.na_prob_file:
            chances = read_na_probabilities(spark, options.na_prob_file)
        metrics = evaluate_v2(golds, predictions, chances, options.na_prob_thresh, options.curves)
    if options.out_file:
        write_metrics(metrics, options.out_file)
    else:
        metrics.orderBy("key").show(100, truncate=False)


if __name__ == "__main__":
    main()
