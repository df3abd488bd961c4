"""A JSON-RPC service as a source: a client, and a data source that reads a paged method into rows of JSON, as a batch or as a stream.

    spark.dataSource.register(PagedRpc)
    spark.read.format("paged_rpc").option("url", url).option("method", "items.list").load()
    spark.readStream.format("paged_rpc").option("url", url).option("method", "items.list").load()

The number of rows comes from the option `total`, or from the total in the service's first answer, or else from a search for the last page
(offsets are doubled, then halved: a logarithm of calls). Pages are dealt to tasks, as many a task as `pages_per_task` says.
A stream reads what was added behind the position it had reached; the position is its offset, so a restart goes on there.
"""

from __future__ import annotations

import itertools
import json
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lectern.errors import EngineError, InvalidParams
from lectern.operators.paging import concatenated

#: Names under which services list rows.
ROW_NAMES = ("items", "tags", "results", "data")


class RpcError(EngineError):
    """What the service answered instead of a result."""

    def __init__(self, code: int, message: str):
        super().__init__(f"[{code}] {message}")
        self.code = code


class RpcClient:
    def __init__(self, url: str, timeout: float = 30.0):
        self.url, self.timeout, self.numbers = url, timeout, itertools.count(1)

    def call(self, method: str, params: dict | None = None):
        body = json.dumps({"jsonrpc": "2.0", "method": method, "params": params or {}, "id": next(self.numbers)}).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                found = json.loads(answer.read())
        except urllib.error.URLError as e:
            raise ConnectionError(f"no service at {self.url}: {e.reason}") from e
        if "error" in found:
            raise RpcError(found["error"]["code"], found["error"]["message"])
        return found.get("result")

    def page(self, method: str, params: dict, limit: int, offset: int) -> list:
        return self._listed(method, self.call(method, params | {"limit": limit, "offset": offset}))

    def total(self, method: str, params: dict | None = None, size: int = 100) -> int:
        """The number of rows of a paged method: what the first answer says, or the end of the last page."""
        params = params or {}
        result = self.call(method, params | {"limit": size, "offset": 0})
        if isinstance(result, dict) and isinstance(result.get("total"), int):
            return result["total"]
        first = self._listed(method, result)
        if len(first) < size:
            return len(first)
        # page `low` is full; page `high` isn't
        low, high, rows = 0, 1, self.page(method, params, size, size)
        while len(rows) == size:
            if rows == first:
                raise InvalidParams("a page repeats the one before")
            low, high = high, 2 * high
            rows = self.page(method, params, size, high * size)
        while high - low > 1:
            middle = (low + high) // 2
            found = self.page(method, params, size, middle * size)
            if len(found) == size:
                low = middle
            else:
                high, rows = middle, found
        return high * size + len(rows)

    @staticmethod
    def _listed(method: str, result) -> list:
        if isinstance(result, dict):
            result = next((result[n] for n in ROW_NAMES if n in result), None)
        if not isinstance(result, list):
            raise InvalidParams(f"{method} doesn't list rows")
        return result

    def rows(self, method: str, params: dict | None = None, size: int = 100) -> list:
        """All rows of a paged method."""
        return concatenated((self.page(method, params or {}, size, k) for k in itertools.count(0, size)), size)


class _Pages(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class _Paged:
    """What both readers do: pages from first to last, dealt to tasks."""

    def __init__(self, options: dict):
        self.client = {"url": options["url"], "timeout": float(options.get("timeout", 30))}
        self.method, self.params = options["method"], json.loads(options.get("params", "{}"))
        self.size, self.step = int(options.get("size", 100)), int(options.get("pages_per_task", 1))
        self.given = int(options["total"]) if "total" in options else None

    def rows_now(self) -> int:
        return RpcClient(**self.client).total(self.method, self.params, self.size) if self.given is None else self.given

    def dealt(self, first: int, last: int) -> list[InputPartition]:
        return [_Pages(k, min(k + self.size * self.step, last)) for k in range(first, last, self.size * self.step)]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        client, at = RpcClient(**self.client), partition.first
        while at < partition.last:
            wanted = min(self.size, partition.last - at)
            rows = client.page(self.method, self.params, wanted, at)
            for k, row in enumerate(rows, at):
                yield k, json.dumps(row, ensure_ascii=False, sort_keys=True)
            if len(rows) < wanted:
                return
            at += len(rows)


class _Reader(_Paged, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self.dealt(0, self.rows_now())


class _StreamReader(_Paged, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {"position": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"position": self.rows_now()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.dealt(start["position"], end["position"])

    def commit(self, end: dict) -> None:
        pass


class PagedRpc(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_rpc"

    def schema(self) -> str:
        return "position long, row string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(dict(self.options))
