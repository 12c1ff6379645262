"""HTTP: status, tables, queries and a benchmark, on the loopback address unless told otherwise."""

from __future__ import annotations

import json
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import functions as F

from tidewater.assistant import Assistant
from tidewater.cli import VERSION
from tidewater.errors import EngineError
from tidewater.operators.learned_index import PGMIndex
from tidewater.session import Engine

#: The fewest and most keys of the benchmark, and rows that an answer holds at most.
LEAST_KEYS, MOST_KEYS, MOST_ROWS = 1_000, 200_000, 10_000
MOST_BYTES = 1 << 20


def benchmark(engine: Engine, size: int) -> dict:
    """A learned index over `size` keys against reading them all."""
    n = min(max(size, LEAST_KEYS), MOST_KEYS)
    df = engine.spark.range(n).select((F.col("id") * 3).alias("k"))
    began = time.perf_counter()
    index = PGMIndex.build(df, "k")
    segments = len(index._loaded())
    built = time.perf_counter()
    rank = index.rank(1.5 * n)
    looked = time.perf_counter()
    actual = df.where(F.col("k") < 1.5 * n).count()
    return {"keys": n, "segments": segments, "build_s": built - began, "rank_s": looked - built, "scan_s": time.perf_counter() - looked, "rank": rank, "actual": actual}


class Handler(BaseHTTPRequestHandler):
    engine: Engine
    assistant: Assistant

    def log_message(self, *_: object) -> None:
        pass

    def answer(self, body: object, code: int = 200, kind: str = "application/json") -> None:
        data = (body if isinstance(body, str) else json.dumps(body, default=str)).encode()
        self.send_response(code)
        for k, v in (("Content-Type", kind), ("Content-Length", str(len(data))), ("Access-Control-Allow-Origin", "*"), ("Access-Control-Allow-Methods", "GET, POST, OPTIONS"), ("Access-Control-Allow-Headers", "Content-Type")):
            self.send_header(k, v)
        self.end_headers()
        self.wfile.write(data)

    def do_OPTIONS(self) -> None:
        self.answer("")

    def do_GET(self) -> None:
        if self.path in ("/health", "/healthz"):
            return self.answer({"status": "ok"})
        if self.path == "/api/status":
            return self.answer({"version": VERSION, "spark": self.engine.spark.version, "commit": self.engine.database.latest()})
        if self.path == "/api/tables":
            return self.answer([self.engine.describe(t).to_json() for t in self.engine.tables()])
        if self.path == "/api/ai/info":
            return self.answer({"model": self.assistant.model is not None})
        if self.path == "/":
            return self.answer("<title>Tidewater</title><p>POST SQL to /api/query as {\"sql\": \"...\"}", kind="text/html")
        return self.answer({"error": "no such path"}, 404)

    def do_POST(self) -> None:
        size = int(self.headers.get("Content-Length") or 0)
        if size > MOST_BYTES:
            return self.answer({"error": "too long"}, 413)
        try:
            body = json.loads(self.rfile.read(size) or b"{}")
        except ValueError:
            return self.answer({"error": "not JSON"}, 400)
        try:
            if self.path == "/api/query":
                sql = body.get("sql") or body.get("query") or ""
                df = self.engine.sql(sql)
                rows = df.limit(MOST_ROWS + 1).collect()
                return self.answer({"columns": self.engine.header(sql, df), "rows": [list(r) for r in rows[:MOST_ROWS]], "more": len(rows) > MOST_ROWS})
            if self.path == "/api/chat":
                return self.answer(self.assistant.reply(body.get("message", "")))
            if self.path == "/api/benchmark":
                return self.answer(benchmark(self.engine, int(body.get("size", LEAST_KEYS))))
        except (EngineError, ValueError) as e:
            return self.answer({"error": str(e), "kind": type(e).__name__}, 400)
        return self.answer({"error": "no such path"}, 404)


def make_server(engine: Engine, port: int, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    return ThreadingHTTPServer((host, port), type("Bound", (Handler,), {"engine": engine, "assistant": Assistant(engine)}))


def serve(engine: Engine, port: int, host: str = "127.0.0.1") -> None:
    make_server(engine, port, host).serve_forever()
