"""Search service: request and response as plain functions, and a small HTTP server around them."""

from __future__ import annotations

import json
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.operators import retrieval
from termforge.operators.index import Index

TOP = 10


def response_rows(results: DataFrame, query: str, mode: str) -> DataFrame:
    """(query, mode, response): the JSON response of one ranked result (doc_id, score), without timing."""
    rows = results.agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("k"), "doc_id", "score"))).alias("r"))  # at most TOP rows
    items = F.transform("r", lambda x: F.struct(x["doc_id"].alias("docid"), F.round(x["score"], 6).alias("score")))
    body = F.struct(items.alias("results"), F.size("r").alias("totalResults"), F.lit(query).alias("query"), F.lit(mode).alias("mode"))
    return rows.select(F.lit(query).alias("query"), F.lit(mode).alias("mode"), F.to_json(body).alias("response"))


def handle_search(index: Index | None, body: bytes | str) -> tuple[int, dict]:
    """Status and response of a search request {query, mode}; mode defaults to AND, ten results at most."""
    started = time.perf_counter()
    try:
        request = json.loads(body or "{}")
        query, mode = str(request.get("query") or "").strip(), str(request.get("mode") or "AND").upper()
        if not query:
            return 400, {"error": "query is empty"}
        if mode not in ("AND", "OR"):
            return 400, {"error": "mode must be AND or OR"}
        if index is None:
            return 500, {"error": "no index"}
        found = retrieval.search_topk(index, query, TOP, mode=mode).collect()
        results = [{"docid": r["doc_id"], "score": r["score"]} for r in found]
        return 200, {"results": results, "searchTime": (time.perf_counter() - started) * 1000, "totalResults": len(results), "query": query, "mode": mode}
    except Exception as e:
        return 500, {"error": str(e)}


def health(index: Index | None) -> dict:
    return {"status": "ok" if index is not None else "no index", "documents": index.n_docs if index is not None else 0}


PAGE = """<!doctype html><title>search</title><form id=f><input id=q><select id=m><option>AND<option>OR</select><button>search</button></form><ol id=r></ol>
<script>f.onsubmit=async e=>{e.preventDefault();const x=await(await fetch('/search',{method:'POST',body:JSON.stringify({query:q.value,mode:m.value})})).json();
r.innerHTML='';(x.results||[]).forEach(d=>{const l=document.createElement('li');l.textContent=d.docid+' '+(d.score?d.score.toFixed(3):'N/A');r.append(l)})}</script>"""


def server(index: Index | None, port: int = 8000) -> HTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, kind: str, data: str) -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.end_headers()
            self.wfile.write(data.encode())

        def do_GET(self):  # noqa: N802
            if self.path == "/health":
                self._send(200, "application/json", json.dumps(health(index)))
            elif self.path == "/":
                self._send(200, "text/html; charset=utf-8", PAGE)
            else:
                self._send(404, "application/json", "{}")

        def do_POST(self):  # noqa: N802
            status, answer = handle_search(index, self.rfile.read(int(self.headers.get("Content-Length") or 0))) if self.path == "/search" else (404, {})
            self._send(status, "application/json", json.dumps(answer))

        def log_message(self, *args):
            pass

    return HTTPServer(("127.0.0.1", port), Handler)
