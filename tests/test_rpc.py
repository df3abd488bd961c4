"""Paged methods as partitions and as a stream, against a local service."""

import http.server
import json
import threading

import pytest

from lectern.errors import InvalidParams
from lectern.sources import rpc


class Service(http.server.BaseHTTPRequestHandler):
    """items.list tells its total, items.all doesn't, stuck gives the same page whatever the offset."""

    rows = 0
    asked: list = []

    def do_POST(self):  # noqa: N802
        ask = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        p = ask["params"]
        type(self).asked.append((ask["method"], p["offset"], p["limit"]))
        at = 0 if ask["method"] == "stuck" else p["offset"]
        found = [{"n": k} for k in range(at, min(at + p["limit"], type(self).rows))]
        result = {"items": found, "total": type(self).rows} if ask["method"] == "items.list" else found
        body = json.dumps({"jsonrpc": "2.0", "id": ask["id"], "result": result}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture
def url():
    Service.rows, Service.asked = 0, []
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/rpc"
    server.shutdown()


def loaded(reader, url, **options):
    return reader.format("paged_rpc").option("url", url).options(**{"size": "10", "method": "items.list"} | options).load()


@pytest.mark.parametrize("rows", [0, 1, 9, 10, 11, 20, 79, 80, 81, 1000, 1013])
def test_totals(url, rows):
    Service.rows = rows
    client = rpc.RpcClient(url)
    assert client.total("items.list", size=10) == client.total("items.all", size=10) == rows
    assert len([a for a in Service.asked if a[0] == "items.all"]) <= 16
    if rows > 10:
        with pytest.raises(InvalidParams):
            client.total("stuck", size=10)


@pytest.mark.parametrize("method", ["items.list", "items.all"])
def test_pages_are_dealt_without_a_total(spark, url, method):
    Service.rows = 57
    spark.dataSource.register(rpc.PagedRpc)
    read = loaded(spark.read, url, method=method)
    assert read.rdd.getNumPartitions() == 6
    assert sorted((r.position, json.loads(r.row)["n"]) for r in read.collect()) == [(k, k) for k in range(57)]
    assert loaded(spark.read, url, method=method, pages_per_task="4").rdd.getNumPartitions() == 2


def test_a_stream_goes_on_where_it_was(spark, url, tmp_path):
    spark.dataSource.register(rpc.PagedRpc)
    seen = []
    for rows in (25, 25, 61):
        Service.rows, Service.asked = rows, []
        stream = loaded(spark.readStream, url).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        stream.awaitTermination()
        seen.append(sorted(r.position for r in spark.read.schema("position long, row string").parquet(f"{tmp_path}/out").collect()))
        if rows == 61:
            # the pages before aren't read again
            assert min(offset for _, offset, _ in Service.asked if offset) >= 25
    assert seen == [list(range(25)), list(range(25)), list(range(61))]
