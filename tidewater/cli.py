"""Commands: index, search, serve, export-features, train, quality.

    python -m tidewater.cli index --index DIR --mapping FILE --docs FILE
    python -m tidewater.cli search --index DIR [--size N] [--field F] QUERY
    python -m tidewater.cli serve --root DIR [--port N] [--model FILE]
    python -m tidewater.cli export-features --index DIR --judgments FILE --out DIR [--top-n N]
    python -m tidewater.cli train --pool DIR --out FILE [--kind linear|trees]
    python -m tidewater.cli quality --index DIR --judgments FILE [--field F]
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession


def session() -> SparkSession:
    return SparkSession.builder.appName("tidewater").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    from tidewater.operators import pool, rankers
    from tidewater.operators.search import Searcher
    from tidewater.serving.service import SearchService, serve
    from tidewater.sources import documents, store
    from tidewater.streaming.writer import index_frame

    parser = argparse.ArgumentParser("tidewater", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = parser.add_subparsers(dest="command", required=True)
    for name, options in (
        ("index", (("--index", {"required": True}), ("--mapping", {"required": True}), ("--docs", {"required": True}))),
        ("search", (("--index", {"required": True}), ("--size", {"type": int, "default": 10}), ("--field", {}), ("query", {"nargs": "*"}))),
        ("serve", (("--root", {"required": True}), ("--host", {"default": "127.0.0.1"}), ("--port", {"type": int, "default": 8080}), ("--model", {}))),
        ("export-features", (("--index", {"required": True}), ("--judgments", {"required": True}), ("--out", {"required": True}), ("--field", {}), ("--top-n", {"type": int, "default": 1000}))),
        ("train", (("--pool", {"required": True}), ("--out", {"required": True}), ("--kind", {"default": "linear", "choices": ("linear", "trees")}))),
        ("quality", (("--index", {"required": True}), ("--judgments", {"required": True}), ("--field", {}))),
    ):
        p = sub.add_parser(name)
        for flag, kw in options:
            p.add_argument(flag, **kw)
    a = parser.parse_args(args)
    spark = spark or session()
    if a.command == "index":
        schema = documents.read_mapping(a.mapping, spark).with_id()
        index = index_frame(documents.read_jsonl(spark, a.docs, schema), schema, a.index)
        print(json.dumps({"generation": index.generation, "documents": index.doc_count()}))
    elif a.command == "search":
        found = Searcher(store.open_index(spark, a.index)).search(" ".join(a.query), a.field, size=a.size)
        print(json.dumps({"total": found.total_hits, "hits": [{"_id": h.id, "_score": h.score} for h in found.hits]}))
    elif a.command == "serve":
        model = None
        if a.model:
            with open(a.model, encoding="utf-8") as f:
                model = rankers.ModelRanker(rankers.ObliviousTrees(json.load(f)))
        service = SearchService(spark, a.root, model=model)
        server = serve(service, a.host, a.port)
        try:
            server.serve_forever()
        except KeyboardInterrupt:
            service.stop()
    elif a.command == "export-features":
        judged = documents.read_judgments(spark, a.judgments)
        from tidewater.functions.metrics import auto_query_ids

        numbered = auto_query_ids(judged.withColumnRenamed("query_id", "given")).selectExpr("query", "doc_id", "label", "coalesce(given, query_id) AS query_id")
        pool.write_pool(pool.pool(store.open_index(spark, a.index), numbered, a.field, a.top_n), a.out)
        with open(f"{a.out}.cd", "w", encoding="utf-8") as f:
            f.write(pool.column_description())
    elif a.command == "train":
        rows = [(float(r[0]), r[1], [float(x) for x in r[2:]]) for r in spark.read.option("sep", "\t").csv(a.pool).collect()]
        with open(a.out, "w", encoding="utf-8") as f:
            f.write(rankers.train_linear(rows).to_json() if a.kind == "linear" else json.dumps(rankers.train_trees(rows)))
    elif a.command == "quality":
        from tidewater.serving import report

        index = store.open_index(spark, a.index)
        print(json.dumps(report.quality_report(spark, report.engine(index, a.field), documents.read_judgments(spark, a.judgments))))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
