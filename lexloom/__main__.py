"""python -m lexloom parse-raw|load|retrieve: files to rows, rows to tables, tables to answers."""

from __future__ import annotations

import argparse
import datetime as dt
import textwrap

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexloom import engine
from lexloom.operators import search
from lexloom.operators.enrich import hash_provider
from lexloom.operators.fusion import Settings, environment
from lexloom.ship import ship
from lexloom.sources import akn, files
from lexloom.streaming import incremental
from lexloom.tables import clear, table


def arguments(args: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="lexloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    raw = sub.add_parser("parse-raw", help="XML files to JSON lines")
    raw.add_argument("--input", required=True)
    raw.add_argument("--output", required=True)
    raw.add_argument("--limit", type=int, default=0)
    raw.add_argument("--pretty", help="a folder for the same as indented JSON texts")
    raw.add_argument("--recover", action=argparse.BooleanOptionalAction, default=True)
    load = sub.add_parser("load", help="new XML files, or JSON lines of parse-raw, to tables with topics and vectors")
    load.add_argument("--input", required=True)
    load.add_argument("--output", required=True)
    load.add_argument("--thesaurus", help="RDF/XML of the thesaurus")
    load.add_argument("--jsonl", action="store_true")
    ask = sub.add_parser("retrieve", help="answers from the tables")
    ask.add_argument("--tables", required=True)
    ask.add_argument("--query", required=True)
    ask.add_argument("--date")
    ask.add_argument("--top-k", type=int)
    ask.add_argument("--final-k", type=int, default=5)
    ask.add_argument("--full-text", action="store_true")
    ask.add_argument("--verbose", action="store_true")
    return p.parse_args(args)


def answers(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    """The lines that ``retrieve`` prints."""
    given = {"final_k": a.final_k} | ({"top_k": a.top_k} if a.top_k else {})
    settings = Settings.of(environment(), **given)
    graph = engine.build(*(table(spark, a.tables, t) for t in ("works", "nodes", "edges", "concepts", "broader")))
    asked = engine.ask(spark, [("q", a.query)], hash_provider())
    day = F.coalesce(F.try_to_date(F.lit(a.date or dt.date.today().isoformat()), "yyyy-MM-dd"), F.current_date())
    concepts = search.topic_top_k(graph.topic_links, engine.analyze(graph, asked)[1], settings.top_k).select("query_id", "id", "concepts") if a.verbose else None
    rows = engine.printed(engine.retrieve(graph, asked, day, settings), concepts, a.full_text).orderBy(F.col("place").asc_nulls_last(), "id").collect()
    out = [f"{len(rows)} results"]
    for n, r in enumerate(rows, 1):
        out.append(f"[{n}] {r['score']:.4f} {r['source']} ({r['context']})")
        out += [f"    {name}: {r[c]}" for name, c in (("act", "title"), ("urn", "urn"), ("topics", "topics")) if r[c] and r[c] != "urn:unknown"]
        out += [f"    id: {r['id']}"] if a.verbose else []
        out += textwrap.wrap(r["text"], 120, initial_indent="    ", subsequent_indent="    ") + [""]
    return out


def main(args: list[str] | None = None) -> None:
    a = arguments(args)
    spark = SparkSession.builder.appName("lexloom").getOrCreate()
    ship(spark)
    if a.command == "parse-raw":
        docs = akn.parsed(akn.scan(spark, a.input, a.limit), recover=a.recover)
        files.write_jsonl(docs, a.output)
        if a.pretty:
            files.pretty(docs).select("json").write.mode("overwrite").text(a.pretty)
        akn.errors(docs).show(20, False)
    elif a.command == "load":
        labels = incremental.thesaurus(spark, a.output, a.thesaurus)
        docs = incremental.parsed_documents(spark, a.input) if a.jsonl else incremental.documents(spark, a.input)
        incremental.load(docs, a.output, f"{a.output}/_checkpoint", labels, hash_provider()).awaitTermination()
    else:
        print("\n".join(answers(spark, a)))
    clear(spark)


if __name__ == "__main__":
    main()
