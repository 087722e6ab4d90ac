"""Command line. Only counts are printed, never an extract of text. Tables hold the original values: protect their path.

``mask IN OUT TABLES``: one file ``<path below IN>.pseudonymise.txt`` per document in OUT, code tables of this run under TABLES.
``restore REPLIES TABLES OUT``: a reply's path below REPLIES is that of its document below IN, with or without the ending that
``mask`` adds; one file ``<path>.reinjecte.txt`` per reply. ``--run`` takes the tables of a run other than the latest.
``evaluate TEXTS TRUTH``: scores the analysis of texts against annotations; the status is 2 if either is missing, 1 if a criterion is
not met. ``references CASES``: outcomes of a file of reference cases. ``--model pkg.module:function`` names what loads a predictor.
"""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from veilwork.functions import values
from veilwork.operators import evaluation, reinjection
from veilwork.plans import pipeline
from veilwork.sources import files


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = parser.add_subparsers(dest="action", required=True)
    wanted = {"mask": ("source", "out", "tables"), "restore": ("replies", "tables", "out"), "evaluate": ("texts", "truth"), "references": ("cases",)}
    for action, names in wanted.items():
        one = sub.add_parser(action)
        for name in names:
            one.add_argument(name)
        if action != "restore":
            one.add_argument("--model", help="pkg.module:function that loads a predictor; without it there are rules only")
            one.add_argument("--threshold", type=float, default=values.MODEL_THRESHOLD)
        if action in ("mask", "restore"):
            one.add_argument("--run")
        if action == "evaluate":
            one.add_argument("--false-alarms", action="store_true", help="count false alarms by category")
    return parser.parse_args(argv)


def _loader(name: str) -> Callable:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)()


def _analysed(docs: DataFrame, args: argparse.Namespace) -> DataFrame:
    if not args.model:
        return pipeline.analyse(docs)
    docs = pipeline.with_model(docs, lambda: _loader(args.model), threshold=args.threshold)
    return pipeline.analyse(docs, model_col="model")


def mask(spark: SparkSession, args: argparse.Namespace) -> int:
    read = files.read_documents(spark, args.source)
    for r in files.rejects(read).groupBy("reason").count().orderBy("reason").collect():
        print(f"{r['count']} : {r['reason']}")
    docs = files.readable(read).where("text RLIKE '\\\\S'").withColumn("doc_id", files.key_below(spark, F.col("path"), args.source))
    run = args.run or files.new_run()
    work = f"{args.tables.rstrip('/')}/_{run}"  # beside the tables, as it holds original values, too
    pipeline.mask(_analysed(docs, args), names=bool(args.model)).select("doc_id", "spans", "flags", "code_table", "masked_text").write.parquet(work)
    files.protect(spark, args.tables)
    done = spark.read.parquet(work)  # analysed once, read for each output
    files.write_tables(done, args.tables, run=run)
    files.write_files(done, args.out, "doc_id", "masked_text", files.MASKED_SUFFIX)
    for r in pipeline.counts(done).orderBy("category").collect():
        print(f"{r['category']} : {r['n']}")
    path = spark._jvm.org.apache.hadoop.fs.Path(work)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    print(f"run {run}")
    return 0


def restore(spark: SparkSession, args: argparse.Namespace) -> int:
    tables = files.read_tables(spark, args.tables, key_type="string", run=args.run)
    replies = files.read_replies(spark, args.replies).withColumn("key", files.key_below(spark, F.col("path"), args.replies))
    replies = replies.withColumn("key", F.regexp_replace("key", files.MASKED_SUFFIX.replace(".", "\\.") + "$", ""))
    bad = replies.where("error IS NOT NULL").count()
    good = replies.where("error IS NULL").join(tables, F.col("key") == F.col("doc_id"), "left")
    lone = good.where("doc_id IS NULL").count()
    done = reinjection.reinject(good.where("doc_id IS NOT NULL"))
    files.write_files(done, args.out, "key", "restored", files.RESTORED_SUFFIX)
    sums = done.agg(F.sum("n_replaced").alias("n"), F.sum(F.size("to_check")).alias("c"), F.sum(F.size("unmentioned")).alias("u")).first()
    print(f"{sums['n'] or 0} remplaces, {sums['c'] or 0} a verifier, {sums['u'] or 0} non mentionnes, {bad} illisibles, {lone} sans table")
    return 0


def evaluate(spark: SparkSession, args: argparse.Namespace) -> int:
    try:
        texts = files.readable(files.read_documents(spark, args.texts)).withColumn("doc_id", files.key_below(spark, F.col("path"), args.texts))
        truth = files.read_truth(spark, args.truth)
        docs = texts.join(truth, F.col("doc_id") == F.col("name"))
        missing = docs.isEmpty()
    except AnalysisException:
        missing = True
    if missing:
        print("corpus absent")
        return 2
    docs = docs.withColumn("expected", evaluation.expected(F.col("text"), F.col("directs")))
    done = _analysed(docs.select("doc_id", "text", "expected"), args).cache()
    scored, predicted = evaluation.score_expected(done), evaluation.score_predicted(done)
    for r in evaluation.report(scored, predicted).orderBy(F.col("category").asc_nulls_last()).collect():
        print(f"{r['category'] or 'total'} : {r['masked']}/{r['expected']} masques, {r['false_alarms']} fausses alertes sur {r['predicted']}")
    print(f"adresses partielles : {evaluation.partial_addresses(scored).count()}")
    if args.false_alarms:
        for r in predicted.where("NOT right").groupBy("category").count().orderBy("category").collect():
            print(f"fausse alerte {r['category']} : {r['count']}")
    met = True
    for r in evaluation.criteria(scored).orderBy("criterion").collect():
        print(f"{r['criterion']} : {r['masked']}/{r['expected']}, {'atteint' if r['met'] else 'non atteint'}")
        met = met and r["met"]
    return 0 if met else 1


def references(spark: SparkSession, args: argparse.Namespace) -> int:
    cases = files.read_cases(spark, args.cases).withColumn("text", F.col("phrase"))
    cases = cases.withColumn("doc_id", F.concat_ws("/", "group", "id"))
    for r in evaluation.references(_analysed(cases, args)).groupBy("group", "outcome").count().orderBy("group", "outcome").collect():
        print(f"{r['group']} {r['outcome']} : {r['count']}")
    return 0


def main(argv: list[str] | None = None) -> int:
    args = _arguments(argv)
    spark = SparkSession.builder.appName("veilwork").getOrCreate()
    return {"mask": mask, "restore": restore, "evaluate": evaluate, "references": references}[args.action](spark, args)


if __name__ == "__main__":
    raise SystemExit(main())
