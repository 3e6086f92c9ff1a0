"""python -m lodestar.cli PATH [-m MODE] [--query Q] [--max-tokens N] [--no-collapse] [-o FILE] [--graph]"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from lodestar.plans import topology


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lodestar")
    p.add_argument("path")
    p.add_argument("-m", "--mode", default="dump")
    p.add_argument("--vocabulary", help="a file of byte-pair ranks to count tokens by")
    p.add_argument("--query")
    p.add_argument("--max-tokens", type=int)
    p.add_argument("--no-collapse", action="store_true")
    p.add_argument("-o", "--output")
    p.add_argument("--graph", action="store_true", help="the graph as JSON instead")
    a = p.parse_args(args)
    try:
        options = topology.Options(a.mode, a.query, a.max_tokens, not a.no_collapse, a.vocabulary).checked()
        spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
        text = topology.export_graph(spark, a.path) or "null" if a.graph else topology.run(spark, a.path, options)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if a.output:
        Path(a.output).write_text(text)
    else:
        print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
