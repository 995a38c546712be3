"""Command line: validate, convert, extract, list-features, evaluate, tag.  Exit 0: all well; 1: something was refused; 2: wrong usage."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession, functions as F

from voxtide import catalog
from voxtide.session import session, ship
from voxtide.sources import documents, manifests, sinks, wav


#: Refused documents that are named; the rest is counted.
NAMED = 100


def _load(spark: SparkSession, path: str) -> documents.Documents:
    """The documents of a folder; each file is read as what it is, and what is neither is refused as JSON."""
    files = documents.texts(spark, path).withColumn("kind", F.coalesce(documents.sniff(F.col("content"), F.col("path")), F.lit("json")))
    kinds = {r.kind for r in files.select("kind").distinct().collect()} or {"json"}  # two at most
    parts = [read(files.where(F.col("kind") == k).drop("kind")) for k, read in (("json", documents.read_json), ("chat", documents.read_chat)) if k in kinds]
    if len(parts) == 1:
        return parts[0]
    return documents.Documents(**{f: getattr(parts[0], f).unionByName(getattr(parts[1], f), allowMissingColumns=True) for f in vars(parts[0])})


def _refused(docs: documents.Documents) -> int:
    """How many documents are refused; the first NAMED are named."""
    n = docs.errors.count()
    for r in docs.errors.orderBy("recording_id").limit(NAMED).collect() if n else []:
        print(f"{r.recording_id}: {r.code}: {r.message}", file=sys.stderr)
    if n > NAMED:
        print(f"and {n - NAMED} more", file=sys.stderr)
    return n


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="voxtide", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("validate", "convert", "extract"):
        s = sub.add_parser(name)
        s.add_argument("documents")
        if name != "validate":
            s.add_argument("output")
        if name == "convert":
            s.add_argument("--to", choices=("json", "chat"), required=True)
        if name == "extract":
            s.add_argument("--manifest")
            s.add_argument("--audio")
            s.add_argument("--task-spec")
            s.add_argument("--packs", nargs="+", choices=catalog.PACKS)
            s.add_argument("--levels", nargs="+", choices=catalog.LEVELS)
        s.add_argument("--force", action="store_true")
    f = sub.add_parser("list-features")
    for o in ("pack", "level", "domain"):
        f.add_argument(f"--{o}")
    e = sub.add_parser("evaluate")
    e.add_argument("gold")
    e.add_argument("predicted")
    e.add_argument("--report", help="folder for the report as JSON")
    t = sub.add_parser("tag")
    t.add_argument("documents")
    t.add_argument("tiers")
    t.add_argument("output")
    t.add_argument("--force", action="store_true")
    a = p.parse_args(argv)
    spark = spark or session()
    ship(spark)
    if a.command == "list-features":
        try:
            catalog.table(spark, pack=a.pack, level=a.level, domain=a.domain).toPandas().to_csv(sys.stdout, index=False)
        except ValueError as err:
            print(err, file=sys.stderr)
            return 2
        return 0
    if a.command == "evaluate":
        return _evaluate(spark, a.gold, a.predicted, a.report)
    if a.command == "tag":
        return _tag(spark, a.documents, a.tiers, a.output, a.force)
    docs = _load(spark, a.documents)
    bad = _refused(docs)
    mode = "overwrite" if a.force else "errorifexists"
    if a.command == "convert":
        (sinks.to_json if a.to == "json" else sinks.to_chat)(docs).write.mode(mode).partitionBy("recording_id").text(a.output)
    elif a.command == "extract":
        from voxtide.extract import extract
        from voxtide.sources import taskspecs

        try:
            spec = taskspecs.read(spark, a.task_spec) if a.task_spec else None
        except taskspecs.InvalidTaskSpec as err:
            print(err, file=sys.stderr)
            return 2
        wanted = manifests.targets(manifests.read_batch(spark, a.manifest)[0]) if a.manifest else None
        audio = wav.read(spark, a.audio).withColumn("recording_id", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)) if a.audio else None
        sinks.write_bundle(spark, extract(docs, wanted=wanted, audio=audio, packs=a.packs, levels=a.levels, spec=spec), a.output, a.force)
    return int(bool(bad))


def _evaluate(spark: SparkSession, gold: str, predicted: str, report: str | None) -> int:
    """Rates of CHAT or JSON transcripts of the same name: pooled, and the mean over sessions with its bootstrap interval.

    A CHAT text that isn't valid is scanned leniently; every item that scoring can't settle is counted by its code.
    """
    from voxtide.operators import scoring

    def items(path: str, name: str):
        d = _load(spark, path)
        w = d.tok.where(F.col("kind").isin("word", "filler")).withColumn("tier_role", F.lit("word"))
        strict = scoring.strict_items(w, ["recording_id"])
        broken = documents.texts(spark, path).join(d.errors.select(F.col("recording_id").alias("path")).distinct(), "path", "left_semi")
        loose = scoring.lenient_items(broken, "content").select(F.col("path").alias("recording_id"), "items")
        return strict.unionByName(loose).withColumn("name", F.regexp_extract("recording_id", r"([^/]+)$", 1)).select("name", F.col("items").alias(name))

    g = items(gold, "gold")
    s = scoring.session_scores(g.join(items(predicted, "predicted"), "name"), "gold", "predicted")
    sums = s.agg(*((F.sum(f"{m}_edits") / F.sum(f"{m}_ref")).alias(m) for m in scoring.METRICS), F.count("*").alias("n")).first()
    print("documents", sums.n, *(f"{m} {sums[m]}" for m in scoring.METRICS))
    if report and sums.n:
        means = {r.metric: r["mean"] for r in scoring.report(s, scoring.METRICS).collect()}
        ci = scoring.intervals_of_means(s, scoring.METRICS)
        metrics = {m: {"mean": round(means[m], 4), "ci_95": [round(x, 4) for x in ci[m]], "pooled": sums[m]} for m in scoring.METRICS}
        text = json.dumps({"sessions_evaluated": sums.n, "format_pass_rate": round(sums.n / max(1, g.count()), 4), "metrics": metrics}, indent=2)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(report)
    return 0 if sums.n else 1


def _tag(spark: SparkSession, chat: str, tiers: str, output: str, force: bool) -> int:
    """New %mor and %gra tiers from a Parquet table (path, utt_idx, mor, gra) in CHAT texts of which all else stays; a last line gets its end."""
    from voxtide.sources import tagging

    done, odd = tagging.replace_morphology(documents.texts(spark, chat), spark.read.parquet(tiers))
    done.withColumn("recording_id", F.regexp_extract("path", r"([^/]+)$", 1)).select("recording_id", F.regexp_replace("content", r"\n\z", "").alias("value")).write.mode("overwrite" if force else "errorifexists").partitionBy("recording_id").text(output)
    n = odd.count()
    for r in odd.orderBy("path").limit(NAMED).collect() if n else []:
        print(f"{r.path}: {r.code}", file=sys.stderr)
    return int(n > 0)


if __name__ == "__main__":
    sys.exit(main())
