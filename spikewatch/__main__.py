"""Command line: ``python -m spikewatch --config config.yml --data data.csv --out DIR``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .plans.job import run_job
from .sources.config import load_config
from .sources.readers import read_table


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="spikewatch", description=__doc__)
    p.add_argument("--config", required=True, help="YAML file with dataset and variables sections")
    p.add_argument("--data", required=True, help="input path (any Spark-readable location)")
    p.add_argument("--out", required=True, help="output folder")
    p.add_argument("--desc", default="{}", help='JSON map test column -> description column')
    p.add_argument("--series", action="store_true", help="also write the per-slice series")
    args = p.parse_args(argv)
    source, spec = load_config(args.config, desc_cols=json.loads(args.desc))
    spark = SparkSession.builder.appName("spikewatch").getOrCreate()
    df = read_table(spark, args.data, source.format, source.options)
    run_job(df, spec, args.out, series=args.series)


if __name__ == "__main__":
    main()
