"""The engine from a shell: python -m lexgrove COMMAND; exit code 1 where a check fails.

build SOURCE INDEX [--plain] [--array]   passages of SOURCE (JSON, Parquet of documents) as a saved index
search INDEX QUESTION... [--limit N] [--rules FILE]
evaluate INDEX QUESTIONS [--details] [--ablation] [--plain INDEX] [--floors]
check INDEX QUESTIONS                    ids that no passage has, ids that occur twice, passages without text
sizes INDEX
publish INDEX TARGET
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evaluate as E
from .operators import index as I
from .operators import search as S
from .operators.checkpoints import cut
from .sources import passages as P


def arguments() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lexgrove", description="Citation search on Spark.")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, *places: str) -> argparse.ArgumentParser:
        one = commands.add_parser(name)
        for p in places:
            one.add_argument(p)
        return one

    build = command("build", "source", "index")
    build.add_argument("--plain", action="store_true", help="without stems")
    build.add_argument("--array", action="store_true", help="JSON files that hold one array each")
    search = command("search", "index")
    search.add_argument("questions", nargs="+")
    search.add_argument("--limit", type=int, default=S.DEFAULTS.limit)
    search.add_argument("--rules", help="synonym rules as JSON lines: rule, trigger, more")
    evaluate = command("evaluate", "index", "questions")
    evaluate.add_argument("--details", action="store_true", help="questions whose article is not first")
    evaluate.add_argument("--ablation", action="store_true", help="each correction left out in turn")
    evaluate.add_argument("--plain", help="an index without stems to compare with")
    evaluate.add_argument("--floors", action="store_true", help="exit with 1 below the floors")
    command("check", "index", "questions")
    command("sizes", "index")
    command("publish", "index", "target")
    return out


def shown(table: DataFrame, *columns: str) -> None:
    """A report of few rows, line by line as the cluster hands them over."""
    for row in table.select(*columns).toLocalIterator():
        print("\t".join("-" if x is None else str(x) for x in row))


def source(spark: SparkSession, path: str, array: bool) -> DataFrame:
    if array or path.rstrip("/").endswith((".json", ".jsonl")):
        return P.read_json(spark, path, array)
    return P.from_documents(spark.read.parquet(path))


def evaluated(spark: SparkSession, options: argparse.Namespace, index: I.Index) -> int:
    asked, expected = E.read_questions(spark, options.questions)
    results = cut(S.search(asked, index, S.SearchConfig(limit=E.DEPTH)))
    ranks = E.target_ranks(results, expected, E.norms_of(expected, index.meta))
    measures = E.target_metrics(ranks)
    shown(E.report(measures).orderBy("target"), "target", "n", "line")
    if options.details:
        shown(E.misses(asked, results, ranks).orderBy("qid"), "qid", "articolo", "d", "found")
    if options.ablation:
        shown(E.deltas(E.report(E.ablation(asked, expected, index))).orderBy("config", "target"), "config", "target", "line", "questions")
    if options.plain:
        shown(E.report(E.stemming(asked, expected, index, I.load_if_there(spark, options.plain))).orderBy("config", "target"), "config", "target", "line", "questions")
    if not options.floors:
        return 0
    judged = E.gate(spark, measures)
    shown(judged.orderBy("target", "metric"), "target", "metric", "floor", "value", "ok")
    return 1 if judged.where("not ok").limit(1).count() else 0


def main(given: list[str] | None = None, spark: SparkSession | None = None) -> int:
    options = arguments().parse_args(given)
    spark = spark or SparkSession.builder.appName("lexgrove").getOrCreate()
    if options.command == "build":
        I.save(I.build(source(spark, options.source, options.array), not options.plain), options.index)
        return 0
    if options.command == "sizes":
        shown(I.sizes(spark, options.index), "name", "files", "bytes")
        return 0
    if options.command == "publish":
        try:
            I.publish(spark, options.index, options.target)
        except ValueError as error:
            print(error, file=sys.stderr)
            return 1
        return 0
    index = I.load(spark, options.index)
    if options.command == "evaluate":
        return evaluated(spark, options, index)
    if options.command == "check":
        _, expected = E.read_questions(spark, options.questions)
        ghosts, twice, apart = E.ghosts(expected, index.meta), E.duplicate_ids(index.meta), E.alignment(index.meta, index.texts).where("unmatched > 0")
        found = [(name, df) for name, df in (("unknown", ghosts.select("id")), ("twice", twice.select("id")), ("unmatched", apart.select("unmatched"))) if df.limit(1).count()]
        for name, df in found:
            shown(df.select(F.lit(name), *df.columns).toDF("what", "value"), "what", "value")
        return 1 if found else 0
    asked = spark.createDataFrame(list(enumerate(options.questions, 1)), "qid long, d string")
    rules = spark.read.schema("rule long, trigger string, more string").json(options.rules) if options.rules else None
    results = S.late_text(S.search(asked, index, S.SearchConfig(limit=options.limit), rules), index)
    shown(results.orderBy("qid", "rank"), "qid", "rank", "citazione", "punteggio", "testo")
    return 0


if __name__ == "__main__":
    sys.exit(main())
