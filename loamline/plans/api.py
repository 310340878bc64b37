"""The run store over HTTP: JSON rows by path. Unknown runs and paths are 404."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from ..sources.runs import RunStore

#: Path endings and the tables they show.
TABLES = {
    "hotspots": "hotspot_files", "knowledge": "knowledge_files", "coupling": "coupling_pairs", "pain": "file_pain", "anemic": "anemic_classes", "complexity": "complexity_functions",
    "clusters": "cluster_summaries", "drift": "cluster_drift", "effort": "effort_files", "cognitive": "dx_cognitive_files", "god-classes": "god_class_classes",
}


def answer(store: RunStore, url: str) -> tuple[int, object]:
    """Status and JSON value for a GET of url."""
    parts = urlsplit(url)
    path, query = parts.path.strip("/").split("/"), parse_qs(parts.query)
    rows = lambda df: [json.loads(x) for x in df.toJSON().collect()]
    try:
        match path:
            case ["api", "repos"]:
                return 200, [r["repo_path"] for r in rows(store.list_repos())]
            case ["api", "runs"] if "repo" in query:
                return 200, rows(store.list_runs(query["repo"][0]))
            case ["api", "runs"]:
                return 422, {"detail": "repo is required"}
            case ["api", "runs", run]:
                row = store.get_run(run)
                return (200, row) if row else (404, {"detail": "Run not found"})
            case ["api", "runs", run, name] if name in TABLES:
                return 200, rows(store.child(TABLES[name], run))
            case ["api", "compare"] if "a" in query and "b" in query:
                a, b = query["a"][0], query["b"][0]
                deltas = rows(store.compare(a, b))[0]["deltas"]
                return 200, {"run_a": store.get_run(a), "run_b": store.get_run(b), "deltas": deltas}
    except KeyError as e:
        return 404, {"detail": f"Run {e.args[0]} not found"}
    return 404, {"detail": "Not Found"}


def serve(store: RunStore, port: int = 8000) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            status, value = answer(store, self.path)
            body = json.dumps(value, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
