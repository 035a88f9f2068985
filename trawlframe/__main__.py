"""python -m trawlframe --url https://site.example: crawl a site and save it."""

from __future__ import annotations

import logging
import signal
import sys
import time

from pyspark.sql import SparkSession

from . import config as settings
from .operators.frontier import summary
from .plans.crawl import crawl


def main(argv: list[str]) -> int:
    try:
        config = settings.load(argv)
    except ValueError as e:
        print(f"configuration: {e}", file=sys.stderr)
        return 2
    logging.basicConfig(level={"warn": "WARNING"}.get(config.log_level, config.log_level.upper()))
    log = logging.getLogger("trawlframe")
    log.info("%s", config)
    spark = SparkSession.builder.appName("trawlframe").getOrCreate()
    began, message = time.time(), "crawl finished"
    counts: dict = {}

    def progress(pages: int, assets: int) -> None:
        counts.update(page=pages, asset=assets)
        log.info("%d of %d pages and %d assets accepted", pages, config.max_count, assets)

    def stop(number: int, frame: object) -> None:
        raise KeyboardInterrupt

    signal.signal(signal.SIGTERM, stop)  # as on an interrupt: running jobs, waits between tries included, are cancelled
    try:
        counts = {r["kind"]: r["n"] for r in summary(crawl(spark, config, progress=progress)).collect()}
    except KeyboardInterrupt:
        spark.sparkContext.cancelAllJobs()
        message = "crawl stopped"
    log.info("%s in %s: %d pages, %d assets", message, settings.Duration(time.time() - began), counts.get("page", 0), counts.get("asset", 0))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
