"""Alignment of files from the command line.

    python -m strandframe.cli pairwise -1 A.fa -2 B.fa [-o OUT] [--no-trace]
    python -m strandframe.cli multiple -i SET.fa [-o OUT]

Scoring: -M match, -X mismatch, -E gap extension, -O gap opening. -T cores of a local session. -W is accepted and has no
effect: blocks don't change results. Files may be FASTA or FASTQ, plain or gzip.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import multiple, pairwise
from .scheme import DEFAULT, DEFAULT_BLOCK, ScoringScheme
from .sources import files


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="strandframe", description="global alignment of sequence files")
    both = argparse.ArgumentParser(add_help=False)
    for flag, name in (("-M", "match"), ("-X", "mismatch"), ("-E", "gap_extend"), ("-O", "gap_open")):
        both.add_argument(flag, dest=name, type=int, default=getattr(DEFAULT, name), help=f"{name}, {getattr(DEFAULT, name)} if not given")
    both.add_argument("-T", dest="threads", type=int, default=10, help="cores of a local session")
    both.add_argument("-W", dest="width", type=int, default=DEFAULT_BLOCK // 16, help="has no effect")
    both.add_argument("-o", dest="output", default="output.txt")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("pairwise", parents=[both], help="the first record of each of two files")
    one.add_argument("-1", dest="first", required=True)
    one.add_argument("-2", dest="second", required=True)
    one.add_argument("--no-trace", action="store_true", help="scores alone, in memory that grows with the lengths")
    sub.add_parser("multiple", parents=[both], help="all records of a file, in their order").add_argument("-i", dest="input", required=True)
    return p.parse_args(argv)


def load_pair(spark: SparkSession, first: str, second: str) -> DataFrame:
    """a, b: the first record of each file."""
    one = [files.read_sequences(spark, path).where("seq_id = 0").select(F.lit(0).alias("k"), F.col("sequence").alias(c)) for path, c in ((first, "a"), (second, "b"))]
    return one[0].join(one[1], "k").drop("k")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments(sys.argv[1:] if argv is None else argv)
    scheme = ScoringScheme(args.match, args.mismatch, args.gap_extend, args.gap_open)
    spark = spark or SparkSession.builder.master(f"local[{args.threads}]").appName("strandframe").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    if args.command == "pairwise":
        pair = load_pair(spark, args.first, args.second)
        df = pairwise.score_pairs(pair, scheme=scheme) if args.no_trace else pairwise.align_pairs(pair, scheme=scheme).withColumn("text", files.pair_text())
        row = df.first()
        if row is None:
            print("a file has no record", file=sys.stderr)
            return 1
        text = None if args.no_trace else row.text
        print(f"global_score={row.global_score} max_cell_score={row.max_cell_score}")
    else:
        seqs = files.read_sequences(spark, args.input)
        row = multiple.progressive(seqs.withColumn("set_id", F.lit(0)), order="seq_id", name="name", scheme=scheme).withColumn("text", files.msa_text()).first()
        text = "consensus:\n" if row is None else row.text
        for r in row.rounds if row else []:
            print(f"round={r.round} nodes_before={r.nodes_before} end_score={r.end_score} nodes_added={r.nodes_added}")
    if text is not None:
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
