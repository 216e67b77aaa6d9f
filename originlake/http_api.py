"""Three routes over the stored history: /search, /validate and /health, JSON, any origin allowed."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession

from originlake.operators import query as Q
from originlake.sources.store import open_store

TRUE = {"true": True, "false": False}


def answer(history, route: str, args: dict[str, str]) -> tuple[int, dict]:
    """Status and body; bad input is 400 with ``{"error": ...}`` only."""
    try:
        number = {k: int(args[k]) for k in ("asn", "max_len", "page", "page_size") if k in args}
        if route == "/search":
            return 200, Q.search_page(
                history,
                number.get("page", 0),
                number.get("page_size", Q.PAGE_SIZE_DEFAULT),
                prefix=args.get("prefix"),
                asn=number.get("asn"),
                max_len=number.get("max_len"),
                date=args.get("date"),
                current=TRUE[args["current"]] if "current" in args else None,
                exact=TRUE[args.get("exact", "true")],
            )
        if route == "/validate":
            return 200, Q.validate_one(history, args["prefix"], number["asn"], args.get("date"))
        if route == "/health":
            return 200, Q.health(history)
    except KeyError as e:
        return 400, {"error": f"missing or invalid {e.args[0]}"}
    except ValueError as e:
        return 400, {"error": str(e)}
    return 404, {"error": "not found"}


def handler(spark: SparkSession, path: str, root: str = "/") -> type[BaseHTTPRequestHandler]:
    under = root.rstrip("/")

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            url = urlsplit(self.path)
            args = {k: v[-1] for k, v in parse_qs(url.query).items()}
            # each request opens the current snapshot, so an update shows without a restart
            route = url.path.removeprefix(under) if url.path.startswith(f"{under}/") else ""
            status, body = answer(open_store(spark, path), route, args)
            raw = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Access-Control-Allow-Origin", "*")
            self.send_header("Access-Control-Allow-Methods", "GET, POST")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_POST = do_GET

        def log_message(self, *args) -> None:
            pass

    return Handler


def serve(spark: SparkSession, path: str, host: str, port: int, root: str = "/") -> None:
    ThreadingHTTPServer((host, port), handler(spark, path, root)).serve_forever()
