import json
import threading
import urllib.parse
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from lexivane.sources import remote

ROWS = [{"generation": f"text {k}", "model": f"m{k % 3}", "attack": "none" if k % 2 else "o'clock", "n": k} for k in range(250)]


@pytest.fixture
def service():
    """A service of rows that is busy the first time it is asked for each page, and notes what it was asked."""
    asked, seen = [], Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path.startswith("/file"):
                self.send_response(200)
                self.end_headers()
                self.wfile.write(b"x" * (3 << 20))
                seen["file"] += 1
                return
            query = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(self.path).query))
            seen[self.path] += 1
            if seen[self.path] == 1 or query.get("where") == '"model"=\'broken\'':
                self.send_response(503)
                self.end_headers()
                return
            asked.append(query)
            rows = ROWS
            for part in filter(None, query.get("where", "").split(" AND ")):
                column, _, value = part.partition("=")
                value = value[1:-1].replace("''", "'") if value.startswith("'") else int(value)
                rows = [r for r in rows if r[column.strip('"')] == value]
            at, n = int(query["offset"]), int(query["length"])
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"num_rows_total": len(rows), "rows": [{"row": r} for r in rows[at : at + n]]}).encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked, seen
    server.shutdown()


def test_pages_conditions_and_retries(spark, service):
    url, asked, _ = service
    schema = "generation string, model string, attack string, n int"
    d = remote.read_pages(spark, f"{url}/rows", schema, {"model": "m1", "attack": "o'clock"}, wait="0.01", length="40")
    got = d.where(F.col("n") > 20).collect()
    assert sorted(r["n"] for r in got) == [r["n"] for r in ROWS if r["model"] == "m1" and r["attack"] == "o'clock" and r["n"] > 20]
    assert all('"model"=\'m1\'' in q["where"] and "o''clock" in q["where"] for q in asked)
    assert sorted({int(q["offset"]) for q in asked}) == [0, 40]
    asked.clear()
    whole = remote.read_pages(spark, f"{url}/rows", schema, wait="0.01", length="40")
    assert whole.count() == 250 and max(int(q["length"]) for q in asked) == 40
    some = spark.read.format("paged").option("url", f"{url}/rows?dataset=x").option("wait", "0.01").option("limit", "45").option("where", '"model"=\'m2\'').load()
    assert some.columns == ["generation"] and some.count() == 45
    with pytest.raises(Exception, match="503"):
        remote.get_json(f"{url}/rows?offset=0&length=1&where=%22model%22%3D%27broken%27", 3, 0.01)


def test_a_file_is_fetched_once(service, tmp_path):
    url, _, seen = service
    path = str(tmp_path / "dump.jsonl")
    assert remote.fetch_file(f"{url}/file", path) and not remote.fetch_file(f"{url}/file", path)
    assert seen["file"] == 1 and (tmp_path / "dump.jsonl").stat().st_size == 3 << 20 and len(list(tmp_path.iterdir())) == 1
