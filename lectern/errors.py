"""Errors of the engine, each with its JSON-RPC code, and the response envelope."""

from __future__ import annotations


class EngineError(Exception):
    code = -32603


class InvalidRequest(EngineError):
    code = -32600


class MethodNotFound(EngineError):
    code = -32601


class InvalidParams(EngineError):
    code = -32602


class NotFound(InvalidParams):
    """A key that no row has."""


class StaleArtifact(EngineError):
    """Derived data that no longer fits its source."""


def envelope(request_id, result=None, error: Exception | None = None) -> dict:
    head = {"jsonrpc": "2.0", "id": request_id}
    if error is None:
        return head | {"result": result}
    return head | {"error": {"code": getattr(error, "code", EngineError.code), "message": str(error)}}
