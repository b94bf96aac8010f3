"""The paged source against a service that answers on this machine: pages until the hit count, one request after another."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from loomgraph import sources

HITS = {"medaka": 7, "rice fish": 3, "none": 0}


@pytest.fixture
def service():
    seen = []

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            seen.append((q["seed"], int(q["page"]), time.monotonic()))
            if q["seed"] == "broken":
                self.send_error(500)
                return
            n, size = HITS[q["seed"]], int(q["size"])
            first = (int(q["page"]) - 1) * size
            body = json.dumps({"hitCount": n, "rows": [{"title": f"{q['seed']} {i}.", "pmid": str(i), "pubYear": "2001"} for i in range(first, min(first + size, n))]}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/?seed={{seed}}&page={{page}}&size={{size}}", seen
    server.shutdown()


def asked(spark, url, seeds):
    sources.ship(spark)
    spark.dataSource.register(sources.PagedSource)
    return spark.read.format("paged").option("url", url).option("seeds", seeds).option("pageSize", "3").option("interval", "0.3").load()


def test_pages_of_a_service(spark, service):
    url, seen = service
    rows = asked(spark, url, "medaka,rice fish,none").collect()
    assert sorted((r["seed"], r["page"]) for r in rows) == sorted([("medaka", p) for p in (1, 1, 1, 2, 2, 2, 3)] + [("rice fish", 1)] * 3)
    requests = {s: [p for q, p, _ in seen if q == s] for s in HITS}
    assert requests == {"medaka": [1, 2, 3], "rice fish": [1], "none": [1]}
    times = [t for q, _, t in seen if q == "medaka"]
    assert all(b - a >= 0.15 for a, b in zip(times, times[1:], strict=False))
    papers = sources.parse_hits(asked(spark, url, "medaka")).where(F.col("pmid") == "6").collect()
    assert [(p["title"], p["year"]) for p in papers] == [("medaka 6", 2001)]


def test_a_service_that_fails(spark, service):
    with pytest.raises(Exception, match="500"):
        asked(spark, service[0], "broken").collect()
