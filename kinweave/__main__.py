"""python -m kinweave --articles FILE --pairs FILE [--only extractor|resolver] [--show-diff] [-v]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from kinweave.operators.extract import RuleClient
from kinweave.plans.evaluation import evaluate_extractor, evaluate_resolver, report, resolver_report
from kinweave.sources.gold import alias_pairs, gold_articles


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="kinweave", description=__doc__)
    parser.add_argument("--articles")
    parser.add_argument("--pairs")
    parser.add_argument("--only", choices=("extractor", "resolver"))
    parser.add_argument("--show-diff", action="store_true")
    parser.add_argument("-v", "--verbose", action="store_true")
    asked = parser.parse_args(args)
    spark = SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if asked.verbose else "ERROR")
    if asked.articles and asked.only != "resolver":
        print(report(evaluate_extractor(gold_articles(spark, asked.articles), RuleClient()), show_diff=asked.show_diff))
    if asked.pairs and asked.only != "extractor":
        print(resolver_report(evaluate_resolver(*alias_pairs(spark, asked.pairs))))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
