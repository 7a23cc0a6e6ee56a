"""Command line: index, query, stats, entities, export, demo."""

from __future__ import annotations

import argparse
import json
import logging
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans.config import Config
from .plans.engine import Engine, last_commit, stored_config
from .sources import corpus


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="weftline", description="Graph-augmented retrieval on Spark.")
    top.add_argument("-v", "--verbose", action="store_true")
    top.add_argument("--storage", default="storage")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("index", help="index a file or folder")
    p.add_argument("path")
    p.add_argument("--append", action="store_true")
    p.add_argument("--chunk-size", type=int)
    p.add_argument("--chunk-overlap", type=int)
    p.add_argument("--extractor", choices=("rule", "llm"))
    p.add_argument("--model")
    p = sub.add_parser("query", help="answer a question")
    p.add_argument("question")
    p.add_argument("--top-k", type=int)
    p.add_argument("--model")
    p.add_argument("--no-generate", action="store_true")
    p.add_argument("--json", action="store_true")
    sub.add_parser("stats", help="counts of an index")
    p = sub.add_parser("entities", help="neighbours of an entity, or the best connected ones")
    p.add_argument("name", nargs="?")
    p.add_argument("--depth", type=int, default=1)
    p = sub.add_parser("export", help="write the graph as JSON or GraphML")
    p.add_argument("out")
    p = sub.add_parser("demo", help="index six passages and answer three questions")
    p.add_argument("--model")
    p.add_argument("--extractor", choices=("rule", "llm"))
    p.add_argument("--save", action="store_true")
    return top


def config_of(spark: SparkSession, args: argparse.Namespace, stored: bool = True) -> Config:
    """Flags over the environment over what the index was stored with, unless a new one replaces it."""
    flags = {k: getattr(args, k, None) for k in ("chunk_size", "chunk_overlap", "extractor", "model", "top_k")}
    return Config.from_env(stored_config(spark, args.storage) if stored else {}, **flags, storage_dir=args.storage)


def cmd_index(spark: SparkSession, args: argparse.Namespace) -> int:
    config = config_of(spark, args, args.append)
    known = args.append and last_commit(spark, args.storage) is not None
    engine = Engine.load(spark, args.storage, config) if known else Engine(spark, config)
    n = engine.add_path(args.path)
    if not n and not engine.table("chunks").limit(1).count():
        print(f"no readable text in {args.path}", file=sys.stderr)
        return 1
    if n:
        engine.save(args.storage)
    print(f"indexed {n} new chunks" if n else "unchanged: nothing new to index")
    print(json.dumps(engine.stats(), indent=2, ensure_ascii=False))
    return 0


def cmd_query(spark: SparkSession, args: argparse.Namespace) -> int:
    config = config_of(spark, args)
    found = Engine.load(spark, args.storage, config).ask(args.question, config.top_k, not args.no_generate)
    if args.json:
        print(json.dumps(found, ensure_ascii=False, indent=2))
        return 0
    print(found["answer"])
    if found["entities"]:
        print(f"entities: {', '.join(found['entities'])}")
    for r in found["retrieved"]:
        signals = " ".join(f"{name}={part:.4f}" for name, part in sorted(r["signals"].items()))
        print(f"[{r['rank']}] {r['score']:.4f} ({signals}) {r['source']}: {r['text'][:180]}")
    return 0


def cmd_stats(spark: SparkSession, args: argparse.Namespace) -> int:
    print(json.dumps(Engine.load(spark, args.storage, config_of(spark, args)).stats(), indent=2, ensure_ascii=False))
    return 0


def cmd_entities(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.depth < 1:
        raise ValueError("depth must be 1 at least")
    engine = Engine.load(spark, args.storage, config_of(spark, args))
    if not args.name:
        found = engine.stats()["graph"]
        print(f"{found['entities']} entities, {found['relationships']} relationships")
        for e in found["top_entities"]:
            print(f"{e['entity']} ({e['degree']})")
        return 0
    keys = engine.related(args.name, args.depth)
    if not keys:
        print(f"nothing is linked to {args.name}", file=sys.stderr)
        return 1
    names = {r[0]: r[1] for r in engine.graph()[0].where(F.col("entity_key").isin(keys)).select("entity_key", "name").collect()}
    print("\n".join(names.get(k, k) for k in keys))
    return 0


def cmd_export(spark: SparkSession, args: argparse.Namespace) -> int:
    engine = Engine.load(spark, args.storage, config_of(spark, args))
    if not engine.graph()[0].limit(1).count():
        print("the graph is empty", file=sys.stderr)
        return 1
    engine.export(args.out)
    print(args.out)
    return 0


def cmd_demo(spark: SparkSession, args: argparse.Namespace) -> int:
    engine = Engine(spark, config_of(spark, args))
    engine.index(corpus.demo(spark), ord_col="doc_ord")
    print(json.dumps(engine.stats(), indent=2))
    for q in corpus.DEMO_QUESTIONS:
        print(f"\n{q}\n{engine.ask(q)['answer']}")
    if args.save:
        engine.save(args.storage)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.WARNING)
    if hasattr(sys.stdout, "reconfigure"):
        sys.stdout.reconfigure(errors="replace")
    try:
        spark = spark or SparkSession.builder.appName("weftline").getOrCreate()
        return globals()[f"cmd_{args.command}"](spark, args)
    except KeyboardInterrupt:
        return 130
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
