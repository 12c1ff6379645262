"""The command line: statements from -e or standard input, or a prompt."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession

from tidewater.errors import EngineError
from tidewater.plans.dialect import statements
from tidewater.session import Engine

VERSION = "0.1.0"
HELP = r"""\dt, SHOW TABLES   tables          \d NAME, DESCRIBE NAME   a table's columns
\status            the engine      \?                       this help
\q                 leave           anything else is SQL, up to a semicolon"""


def grid(df: DataFrame, most: int = 1000, header: list[str] | None = None) -> str:
    """Rows as a grid; NULL where there is no value."""
    rows = [["NULL" if x is None else str(x) for x in r] for r in df.limit(most + 1).collect()]
    more, rows = len(rows) > most, rows[:most]
    names = header or df.columns
    width = [max([len(c), *(len(r[i]) for r in rows)]) for i, c in enumerate(names)]
    line = "+" + "+".join("-" * (w + 2) for w in width) + "+"
    show = lambda r: "|" + "|".join(f" {x:<{w}} " for x, w in zip(r, width, strict=True)) + "|"
    return "\n".join([line, show(names), line, *map(show, rows), *([line] if rows else []), f"({len(rows)} rows{' and more' * more})"])


def run(engine: Engine, sql: str) -> str:
    df = engine.sql(sql)
    return f"{df.first()[0]} rows affected" if df.columns == ["affected"] else grid(df, header=engine.header(sql, df))


def command(engine: Engine, line: str) -> str | None:
    """The answer to a backslash command; None to leave."""
    word, _, rest = line.strip().partition(" ")
    if word == "\\q":
        return None
    if word in ("\\dt", "\\d") and not rest:
        return grid(engine.sql("SHOW TABLES"))
    if word == "\\d":
        return grid(engine.sql(f"DESCRIBE {rest}"))
    if word == "\\status":
        return f"version {VERSION}, Spark {engine.spark.version}, {len(engine.tables())} tables, commit {engine.database.latest()}"
    return HELP


def prompt(engine: Engine) -> None:
    import contextlib

    with contextlib.suppress(ImportError):
        import readline

        history = os.path.expanduser("~/.tidewater_history")
        with contextlib.suppress(OSError):
            readline.read_history_file(history)
    held = ""
    while True:
        try:
            line = input("tidewater> " if not held else "      ...> ")
        except EOFError:
            break
        if not held and line.strip().startswith("\\"):
            if (answer := command(engine, line)) is None:
                break
            print(answer)
            continue
        held += line + "\n"
        if not line.rstrip().endswith(";"):
            continue
        for s in statements(held):
            try:
                print(run(engine, s))
            except EngineError as e:
                print(f"{type(e).__name__}: {e}")
        held = ""
    with contextlib.suppress(Exception):
        readline.write_history_file(history)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidewater", description=__doc__)
    p.add_argument("-e", "--execute", help="statements to run")
    p.add_argument("-w", "--warehouse", help="the database's folder; a temporary one if not given")
    p.add_argument("--serve", nargs="?", const=8080, type=int, metavar="PORT", help="answer HTTP on the loopback address")
    p.add_argument("-q", "--quiet", action="store_true", help="print no results")
    p.add_argument("-V", "--version", action="version", version=VERSION)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("tidewater").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    engine = Engine(spark, a.warehouse)
    if a.serve:
        from tidewater.server import serve

        serve(engine, a.serve)
        return 0
    if a.execute is None and sys.stdin.isatty():
        prompt(engine)
        return 0
    try:
        for s in statements(a.execute if a.execute is not None else sys.stdin.read()):
            out = run(engine, s)
            if not a.quiet:
                print(out)
    except EngineError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
