"""Command line: crawl, and config."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from . import config as C


def _logging(verbose: bool) -> None:
    os.makedirs("logs", exist_ok=True)
    handlers = [logging.StreamHandler(sys.stdout), logging.FileHandler("logs/crawler.log")]
    logging.basicConfig(level=logging.DEBUG if verbose else logging.INFO, format="%(asctime)s %(levelname)s %(name)s %(message)s", handlers=handlers)


def crawl(args: argparse.Namespace) -> int:
    from pyspark.sql import SparkSession

    from .plans.crawl import Crawl

    try:
        config = C.load_yaml(args.config) if args.config else C.CrawlConfig()
        C.validate(C.overridden(config, args.max_depth, args.max_pages, args.allowed_domains, args.user_agent, args.delay))
    except C.ConfigurationError as e:
        print(e, file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("crawl").getOrCreate()
    run = Crawl(spark, config, captures=spark.read.parquet(args.captures) if args.captures else None, folder=args.output)
    try:
        run.run(args.urls, args.timeout)
    except KeyboardInterrupt:
        run.stop()
    print(run.report())
    return 0


def config(args: argparse.Namespace) -> int:
    try:
        if args.create_default:
            C.save_yaml(C.CrawlConfig(), args.output or "config/default.yaml")
        elif args.validate:
            C.validate(C.load_yaml(args.validate))
            print(f"{args.validate} is valid")
        else:
            print("nothing to do: give --create-default or --validate FILE", file=sys.stderr)
            return 1
    except C.ConfigurationError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gossamer", description="Crawl pages into tables with Spark.")
    top.add_argument("-v", "--verbose", action="store_true", help="debug messages")
    commands = top.add_subparsers(dest="command")
    c = commands.add_parser("crawl", help="crawl from seed addresses")
    c.add_argument("urls", nargs="+")
    c.add_argument("-c", "--config", help="YAML file; code defaults without it")
    c.add_argument("-d", "--max-depth", type=int, metavar="N")
    c.add_argument("-p", "--max-pages", type=int, metavar="N")
    c.add_argument("--allowed-domains", nargs="+", metavar="DOMAIN")
    c.add_argument("-t", "--timeout", type=float, metavar="SECONDS")
    c.add_argument("--user-agent", metavar="STRING")
    c.add_argument("--delay", type=float, metavar="SECONDS")
    c.add_argument("--captures", help="Parquet table of captured pages to crawl instead of the network")
    c.add_argument("--output", default="data/crawl", help="folder of the pages, links and images tables")
    c.set_defaults(run=crawl)
    f = commands.add_parser("config", help="create or check configuration files")
    f.add_argument("--create-default", action="store_true")
    f.add_argument("--validate", metavar="FILE")
    f.add_argument("-o", "--output", metavar="FILE")
    f.set_defaults(run=config)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if not args.command:
        parser().print_help()
        return 0
    _logging(args.verbose)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
