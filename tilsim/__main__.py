"""Command line: analyze, check and version."""

from __future__ import annotations

import argparse
import json
import sys

from tilsim import __version__
from tilsim.functions.analysis import analyze

LONGEST = 200
SCHEMA_VERSION = "1"


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("tilsim").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _roots(args) -> frozenset[str] | None:
    if args.lexicon:
        with open(args.lexicon, encoding="utf-8") as f:
            return frozenset(line.split("\t")[0].strip() for line in f if "\t" in line)
    return frozenset(r.strip() for r in args.roots.split(",")) if args.roots else None


def _analyze(args) -> int:
    if len(args.surface) > LONGEST or not args.surface.strip():
        print(f"a surface has 1 to {LONGEST} characters", file=sys.stderr)
        return 2
    found = analyze(args.surface, roots=_roots(args), max_derivation_depth=args.depth)
    sure = _confidence(args) if args.disambiguate and found else None
    if sure is not None:
        found = [found[k] for k in sure]
    if args.json:
        rows = [{"schema_version": SCHEMA_VERSION, "lemma": r.lemma, "pos": r.pos, "kind": r.kind, "kwargs": r.axes, "segments": r.segments, "hypothetical": r.hypothetical} for r in found]
        print(json.dumps([r | {"confidence": c} for r, c in zip(rows, sure.values(), strict=True)] if sure else rows, ensure_ascii=False))
    else:
        shares = [f" ({c:.3f})" for c in sure.values()] if sure else [""] * len(found)
        for i, (r, share) in enumerate(zip(found, shares, strict=True), 1):
            print(f"{i}. {r.lemma} [{r.pos}] {r.kind} {' '.join(f'{k}={v}' for k, v in r.axes.items())}  {'+'.join(p for p, _ in r.parts)}{share}")
    return 0 if found else 1


def _confidence(args) -> dict[int, float]:
    """The places of the readings by their rank, with the confidence of each."""
    from tilsim.operators import ranking
    from tilsim.operators.analyze import reading_rows, readings
    from tilsim.sources.tables import read_lexicon

    from pyspark.sql import functions as F

    spark, roots = _session(), _roots(args)
    given = spark.createDataFrame([(args.surface, sorted(roots) if roots else None)], "surface string, roots array<string>")
    rows = reading_rows(given.select("surface", readings(F.col("surface"), F.col("roots") if roots else None, None, args.depth).alias("readings")))
    lexicon = read_lexicon(spark, args.lexicon) if args.lexicon else None
    ranked = ranking.disambiguate(rows, ["surface"], pos=lexicon).orderBy("rank").collect()
    return {r["ord"]: round(r["confidence"], 6) for r in ranked}


def _check(args) -> int:
    from tilsim.operators.spelling import check
    from tilsim.sources.tables import read_lexicon

    spark = _session()
    roots = _roots(args) or frozenset()
    lexicon = read_lexicon(spark, args.lexicon) if args.lexicon else spark.createDataFrame([(r, "noun") for r in roots], "lemma string, pos string")
    row = check(spark.createDataFrame([(args.word,)], "word string"), lexicon, max_suggestions=args.max_suggestions, max_distance=args.max_distance).first()
    print(json.dumps({"word": args.word, "is_valid": bool(row and row["is_valid"]), "suggestions": list(row["suggestions"]) if row else []}, ensure_ascii=False))
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tilsim")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze")
    a.add_argument("surface")
    a.add_argument("--json", action="store_true")
    a.add_argument("--depth", type=int, default=1)
    a.add_argument("--disambiguate", action="store_true")
    c = sub.add_parser("check")
    c.add_argument("word")
    c.add_argument("--max-suggestions", type=int, default=5)
    c.add_argument("--max-distance", type=float, default=2.0)
    for x in (a, c):
        x.add_argument("--roots", default="")
        x.add_argument("--lexicon", default="")
    sub.add_parser("version")
    args = p.parse_args(argv)
    if args.command == "version":
        print(json.dumps({"version": __version__, "schema_version": SCHEMA_VERSION}))
        return 0
    return _analyze(args) if args.command == "analyze" else _check(args)


if __name__ == "__main__":
    sys.exit(main())
