"""HTTP adapter: POST /query {"sql": ...} gives results and stats, GET /stats the last stats; bad input is a 400."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from itertools import islice

from quadrille.errors import EngineError
from quadrille.render import pieces
from quadrille.session import Engine


def server(engine: Engine, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def reply(self, code: int, body: object) -> None:
            data = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self.reply(200, asdict(engine.stats)) if self.path == "/stats" else self.reply(404, {"error": "not found"})

        def do_POST(self) -> None:
            if self.path != "/query":
                return self.reply(404, {"error": "not found"})
            try:
                asked = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
                answer = self.answer(engine.run(asked["sql"]))
                first = list(islice(answer, 3))  # an error before the first row is still a 400
            except (EngineError, ValueError, KeyError, TypeError) as e:
                return self.reply(400, {"error": str(e)})
            self.send_response(200)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.end_headers()  # the connection's end is the answer's end
            for part in (first, answer):
                for piece in part:
                    self.wfile.write(piece.encode())

        def answer(self, results: list) -> Iterator[str]:
            yield '{"results": ['
            for k, result in enumerate(results):
                yield ", " * (k > 0)
                yield from pieces(result)
            yield f'], "stats": {json.dumps(asdict(engine.stats))}}}'

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
