"""python -m tidemark.cli: replays the conversations of a split through the detectors and prints the summary as JSON."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tidemark.config import Run
from tidemark.plans.chart import bump_chart, save
from tidemark.plans.report import MessageRun, as_json
from tidemark.plans.storage import written
from tidemark.sources.conversations import ChatFiles


def options() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--data-dir", default="data")
    p.add_argument("--train-subdir", default="train_convs")
    p.add_argument("--test-subdir", default="test_convs")
    p.add_argument("--split", choices=("train", "test"), default="test")
    p.add_argument("--all-messages", action="store_true", default=False)
    p.add_argument("--scammer-only", action="store_false", dest="all_messages")
    p.add_argument("--max-messages", type=int, default=200)
    p.add_argument("--freq-query", action="append", default=[])
    p.add_argument("--show-text", action="store_true", default=False)
    p.add_argument("--hide-text", action="store_false", dest="show_text")
    p.add_argument("--exclude-duplicates", action="store_true", default=False)
    p.add_argument("--include-duplicates", action="store_false", dest="exclude_duplicates")
    p.add_argument("--update-interval", type=int, default=100)
    p.add_argument("--top-frequency", type=int, default=10)
    p.add_argument("--chart", metavar="FILE", help="write the bump chart of the burst ranks there, as SVG")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> str:
    o = options().parse_args(args)
    config = Run(interval=o.update_interval, top=o.top_frequency, max_messages=o.max_messages, exclude_duplicates=o.exclude_duplicates)
    spark = spark or SparkSession.builder.appName("tidemark").getOrCreate()
    found = ChatFiles(o.data_dir, o.train_subdir, o.test_subdir, use_skipwords=True)
    run = MessageRun(written(found.messages(spark, o.split, o.max_messages, force_reload=True, all_messages=o.all_messages), "messages"), config)
    out = run.summary(o.split, tuple(o.freq_query), o.show_text)
    if o.chart:
        save(spark, bump_chart(run.rank_table(), o.update_interval), o.chart)
    print(as_json(out))
    print(f"Processed {out['processed']} messages from split '{o.split}'.", file=sys.stderr)
    if o.exclude_duplicates:
        print(f"Excluded {out['excluded_duplicates']} duplicate messages.", file=sys.stderr)
    return as_json(out)


if __name__ == "__main__":
    main()
