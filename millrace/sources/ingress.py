"""HTTP ingress for single rows, beside a Spark program: POST / runs a row, POST /<session> a session's turn, GET /schema shows the module."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from millrace.operators.module import Failed


def serve(pipeline, sessions=None, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """Starts answering in a thread; ``server_address`` has the port, ``shutdown()`` ends it. Rows are run one after another."""
    turn = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, code: int, body: object) -> None:
            data = json.dumps(body, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self._answer(*((200, pipeline.module.spec()) if self.path == "/schema" else (404, {"error": "not found"})))

        def do_POST(self) -> None:
            text, name = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode(), self.path.strip("/")
            try:
                with turn:
                    if not name:
                        self._answer(200, pipeline.one(text))
                    elif name.isdigit() and sessions is not None:
                        self._answer(200, sessions.call(int(name), text))
                    else:
                        self._answer(404, {"error": "not found"})
            except (Failed, ValueError) as e:
                self._answer(422, {"error": str(e)})

        def log_message(self, *args) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
