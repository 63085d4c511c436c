"""Command line: ingest, add, chat, ask, tools."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from docweave.agent import ChatAgent, Post, Reply, default_post
from docweave.plans import engine as E
from docweave.settings import Settings
from docweave.sources.convert import CONVERTIBLE
from docweave.sources.files import convert_files, load_documents


def session() -> SparkSession:
    spark = SparkSession.builder.appName("docweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def build_app(spark: SparkSession, settings: Settings) -> tuple[ChatAgent, Post]:
    post = default_post(spark, settings)
    return post.agents[ChatAgent.name], post


def ingest(spark: SparkSession, settings: Settings, source: str | None = None) -> dict:
    _, counts = E.ingest(load_documents(spark, source or settings.documents_dir), settings)
    print("\n".join(f"{k}: {v}" for k, v in counts.items()))
    return counts


def confirmed(n: int) -> bool:
    return input(f"Incluir {n} arquivo{'s' * (n != 1)} no índice RAG agora? [s/N] ").strip().lower() in ("s", "sim", "y", "yes")


def add(spark: SparkSession, settings: Settings, source: str, out: str | None = None, force: bool = False, include: bool | None = None) -> int:
    """Convert, then index ``documents_dir`` anew if ``include``; None asks on a terminal."""
    try:
        log = convert_files(spark, source, out or settings.documents_dir, force).collect()
    except (ValueError, FileNotFoundError) as e:
        print(e)
        return 1
    for r in log:
        print(r["source"], "->", r["target"], r["reason"] or "gravado")
    if include is None and sys.stdin.isatty():
        include = confirmed(sum(not r["skipped"] for r in log))
    if include:
        ingest(spark, settings)
    elif include is None:
        print("Conversão ok. Passe --ingest para incluir no RAG ou rode: python -m docweave ingest")
    return 0


def chat(spark: SparkSession, settings: Settings, trace: bool) -> int:
    try:
        agent, _ = build_app(spark, settings)
    except FileNotFoundError as e:
        print(e)
        return 1
    print(f"/sair encerra; /trace mostra o rastro; /add caminho converte ({', '.join(sorted(CONVERTIBLE))}).")
    while True:
        try:
            said = input("você> ").strip()
        except (EOFError, KeyboardInterrupt):
            return 0
        word = said.lower()
        if word in ("/sair", "/exit", "/quit"):
            return 0
        if word == "/trace":
            trace = not trace
        elif word.startswith("/add"):
            path = said[4:].strip().strip("\"'")
            if path:
                add(spark, settings, path)
                agent, _ = build_app(spark, settings)
            else:
                print("Uso: /add caminho/do/arquivo.docx")
        elif said:
            show(agent.run(said), trace)


def show(result: Reply, trace: bool) -> None:
    print(result.text)
    for i, c in enumerate(result.citations, 1):
        print(f"[{i}] {c['source']}: {c['preview']}")
    if trace:
        print("\n".join(result.trace))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="docweave")
    sub = parser.add_subparsers(dest="cmd", required=True)
    sub.add_parser("ingest").add_argument("source", nargs="?")
    a = sub.add_parser("add")
    a.add_argument("source")
    a.add_argument("--out")
    a.add_argument("--force", action="store_true")
    which = a.add_mutually_exclusive_group()
    which.add_argument("--ingest", dest="include", action="store_const", const=True)
    which.add_argument("--no-ingest", dest="include", action="store_const", const=False)
    sub.add_parser("chat").add_argument("--trace", action="store_true")
    q = sub.add_parser("ask")
    q.add_argument("question")
    q.add_argument("--trace", action="store_true")
    sub.add_parser("tools")
    args = parser.parse_args(argv)
    spark, settings = session(), Settings.from_env()
    if args.cmd == "ingest":
        ingest(spark, settings, args.source)
        return 0
    if args.cmd == "add":
        return add(spark, settings, args.source, args.out, args.force, args.include)
    if args.cmd == "chat":
        return chat(spark, settings, args.trace)
    agent, _ = build_app(spark, settings)
    if args.cmd == "tools":
        for t in agent.tools.schemas():
            print(t["name"], "-", t["description"])
        return 0
    result = agent.run(args.question)
    show(result, args.trace)
    return 0 if result.quality_ok and result.answer_ok else 2
