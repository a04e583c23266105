"""A small JSON service over one engine, from the standard library: python -m lakelens.serve LAKE [PORT].

POST /ask /intent /execute /edit /correct /discover with a JSON object, GET /overrides /audits /datasets /stats,
DELETE /overrides/ID. Questions are answered one at a time; errors come back as JSON.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import SparkSession

from lakelens.plans.engine import Engine
from lakelens.plans.intent import Intent
from lakelens.plans.plan import Plan
from lakelens.sources.catalog import Catalog


def routes(engine: Engine) -> dict[tuple[str, str], Callable[[dict], object]]:
    """What each method and path does with the body."""
    return {
        ("POST", "/ask"): lambda b: engine.handle(b["question"]),
        ("POST", "/intent"): lambda b: engine.parse(b["question"]).to_dict(),
        ("POST", "/answer"): lambda b: engine.answer(Intent.from_dict(b["intent"], b.get("question", ""))),
        ("POST", "/execute"): lambda b: {k: v for k, v in vars(engine.execute(b["plan"])).items() if k != "df"},
        ("POST", "/edit"): lambda b: Plan.from_dict(b["plan"]).edit(int(b["index"]), b.get("action", "remove"), b.get("params")).to_dict(),
        ("POST", "/correct"): lambda b: engine.correct(b["hint"], b["column"], b.get("dataset"), b.get("slot"), b.get("question")),
        ("POST", "/discover"): lambda b: engine.discover(b["question"]),
        ("GET", "/overrides"): lambda b: [vars(r) for r in engine.overrides.active()],
        ("GET", "/audits"): lambda b: [r.asDict() for r in engine.audit.recent().collect()] if engine.audit else [],
        ("GET", "/datasets"): lambda b: sorted(engine.catalog.paths),
        ("GET", "/stats"): lambda b: engine.feedback.stats(),
        ("DELETE", "/overrides"): lambda b: {"removed": engine.overrides.remove(b["id"])},
    }


def respond(table: dict, method: str, path: str, body: dict) -> tuple[int, object]:
    """(status, result) of one request."""
    head, _, tail = path.strip("/").partition("/")
    act = table.get((method, f"/{head}"))
    if act is None:
        return 404, {"error": f"no {method} {path}"}
    try:
        return 200, act(body | ({"id": tail} if tail else {}))
    except KeyError as e:
        return 400, {"error": f"lacks {e}"}
    except Exception as e:  # noqa: BLE001 - a service gives errors back
        return 500, {"error": f"{type(e).__name__}: {e}"}


def server(engine: Engine, port: int = 8000, host: str = "127.0.0.1") -> HTTPServer:
    table = routes(engine)

    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or "{}")
                status, out = respond(table, self.command, self.path, body) if isinstance(body, dict) else (400, {"error": "an object is wanted"})
            except ValueError as e:
                status, out = 400, {"error": str(e)}
            text = json.dumps(out, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(text)))
            self.end_headers()
            self.wfile.write(text)

        do_GET = do_POST = do_DELETE = _do  # noqa: N815

        def log_message(self, *args: object) -> None:
            pass

    return HTTPServer((host, port), Handler)


if __name__ == "__main__":
    built = Engine(Catalog.of_lake(SparkSession.builder.appName("lakelens").getOrCreate(), sys.argv[1])).build()
    server(built, int(sys.argv[2]) if len(sys.argv) > 2 else 8000).serve_forever()
