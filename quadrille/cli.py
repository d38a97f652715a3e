"""Command line: ``python -m quadrille.cli [--root DIR] [--explain] [FILE]``; without a file, statements are read from the terminal."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from quadrille.errors import EngineError
from quadrille.plans.dialect import parse
from quadrille.render import pieces
from quadrille.session import Engine


def run_text(engine: Engine, text: str, explain: bool = False) -> int:
    try:
        for result in engine.run(text):
            if explain and isinstance(result, DataFrame):
                result.explain("formatted")
            for piece in pieces(result):
                print(piece, end="")
            print()
    except EngineError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


def repl(engine: Engine, lines=None) -> None:
    """Statements may span lines and end with a semicolon; exit leaves."""
    held = ""
    for line in lines or sys.stdin:
        if not held and line.strip().lower() in ("exit", "quit", "exit;", "quit;"):
            return
        held += line
        if line.rstrip().endswith(";"):
            run_text(engine, held)
            held = ""


def main(args: list[str] | None = None) -> int:
    cli = argparse.ArgumentParser(prog="quadrille", description=__doc__)
    cli.add_argument("file", nargs="?")
    cli.add_argument("--root", default="quadrille-tables", help="folder of the tables")
    cli.add_argument("--explain", action="store_true", help="print the plans of queries")
    cli.add_argument("--compact", metavar="TABLE", help="rewrite a table without its deleted rows")
    cli.add_argument("--parse", action="store_true", help="print the statements' trees and run nothing")
    chosen = cli.parse_args(args)
    text = open(chosen.file, encoding="utf-8").read() if chosen.file else None  # noqa: SIM115
    if chosen.parse:
        print(json.dumps([{"statement": type(s).__name__, **asdict(s)} for s in parse(text or sys.stdin.read())], ensure_ascii=False, indent=2))
        return 0
    engine = Engine(SparkSession.builder.appName("quadrille").getOrCreate(), chosen.root)
    if chosen.compact:
        engine.catalog.compact(chosen.compact)
        return 0
    if text is not None:
        return run_text(engine, text, chosen.explain)
    repl(engine)
    return 0


if __name__ == "__main__":
    sys.exit(main())
