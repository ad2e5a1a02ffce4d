"""A small JSON-over-HTTP door to a store, for test drivers. Keys and values are text."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from keystrata import workloads
from keystrata.errors import StoreError, TxConflict
from keystrata.store import Store


def _text(value: bytes | None) -> str | None:
    return None if value is None else value.decode()


def _scan(s: Store, x: dict) -> list[list[str | None]]:
    """All live rows in [from, to); fewer only if the client sets a limit."""
    found = s.scan(x["from"].encode(), x["to"].encode())
    if x.get("limit") is not None:
        found = found.limit(x["limit"])
    return [[_text(bytes(r["user_key"])), _text(bytes(r["value"]))] for r in found.toLocalIterator()]


ROUTES = {
    "/get": lambda s, x: _text(s.get(x["key"].encode())),
    "/scan": _scan,
    "/put": lambda s, x: s.put(x["key"].encode(), x["value"].encode()),
    "/delete": lambda s, x: s.delete(x["key"].encode()),
    "/cas": lambda s, x: s.compare_and_set(x["key"].encode(), None if x["old"] is None else x["old"].encode(), x["new"].encode()),
    "/transfer": lambda s, x: workloads.retried(s, lambda t: workloads.transfer(t, x["from"], x["to"], x["amount"]), 1),
    "/add": lambda s, x: workloads.retried(s, lambda t: workloads.add(t, x["key"].encode(), x.get("amount", 1)), 1),
    "/append": lambda s, x: workloads.retried(s, lambda t: workloads.append(t, x["key"].encode(), x["element"]), 1),
    "/write-all": lambda s, x: workloads.retried(s, lambda t: workloads.write_all(t, {k.encode(): v.encode() for k, v in x["values"].items()}), 1),
}


def serve(store: Store, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server to run with serve_forever(): 200, 404 unknown route, 405 not POST, 409 conflict, 500."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, status: int, body: object) -> None:
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self._answer(405, {"error": "POST only"})

        def do_POST(self) -> None:
            route = ROUTES.get(self.path)
            if route is None:
                return self._answer(404, {"error": "no such route"})
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"{}")
                return self._answer(200, {"ok": route(store, body)})
            except TxConflict as e:
                return self._answer(409, {"error": str(e), "retriable": True})
            except (StoreError, KeyError, ValueError) as e:
                return self._answer(500, {"error": str(e), "retriable": False})

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
