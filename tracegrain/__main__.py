"""``python -m tracegrain [--config FILE] [--data ROOT] [--out ROOT] [--poi CASE]... [--log]``: investigate the configured cases."""

from __future__ import annotations

import argparse
import json
import logging
import time
from pathlib import Path

from pyspark.sql import SparkSession

from tracegrain.plans.cases import Runner
from tracegrain.sources.config import Config, data_root, output_root


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tracegrain", description=__doc__)
    parser.add_argument("--config", help="the experiment's JSON file")
    parser.add_argument("--data", default=data_root(), help="where graphs are stored")
    parser.add_argument("--out", default=output_root(), help="where results and logs go")
    parser.add_argument("--poi", action="append", default=[], help="a case to run; may be repeated")
    parser.add_argument("--log", action="store_true", help="write the output to a file under OUT/logs, too")
    args = parser.parse_args(argv)
    try:
        config = Config.load(args.config)
        config.check()
        cases = config.chosen(args.poi)
    except (OSError, ValueError, json.JSONDecodeError) as odd:
        parser.error(str(odd))
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if args.log:
        folder = Path(args.out) / "logs"
        folder.mkdir(parents=True, exist_ok=True)
        handlers.append(logging.FileHandler(folder / f"investigate-{time.strftime('%Y%m%d-%H%M%S')}.log", encoding="utf-8"))
    logging.basicConfig(level=logging.INFO, format="%(message)s", handlers=handlers, force=True)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    runner = Runner(spark, config, args.data, args.out)
    rows = []
    for case in cases:
        rows.append(runner.investigate(case))
        logging.info("%s: %s", case, {k: v for k, v in rows[-1].items() if k not in ("case", "seconds")})
    for row in rows:
        logging.info("%s, %.1f s", row["case"], row["seconds"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
