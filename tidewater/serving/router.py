"""Routes of literal and :named segments."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import parse_qsl, unquote, urlsplit


@dataclass
class Request:
    method: str
    target: str
    body: bytes = b""
    headers: dict = field(default_factory=dict)
    params: dict = field(default_factory=dict)

    @property
    def path(self) -> str:
        return urlsplit(self.target).path

    @property
    def query(self) -> dict:
        """Of a name given twice the last counts."""
        return dict(parse_qsl(urlsplit(self.target).query, keep_blank_values=True))


def finite(x):
    if isinstance(x, dict):
        return {k: finite(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [finite(v) for v in x]
    return None if isinstance(x, float) and not math.isfinite(x) else x


@dataclass
class Response:
    status: int
    body: dict

    @staticmethod
    def error(status: int, kind: str, reason: str) -> Response:
        return Response(status, {"error": {"type": kind, "reason": reason}})

    def encoded(self) -> bytes:
        """JSON with sorted names. A number that isn't finite becomes null, as JSON has none."""
        try:
            return json.dumps(self.body, ensure_ascii=False, sort_keys=True, allow_nan=False).encode()
        except ValueError:
            return json.dumps(finite(self.body), ensure_ascii=False, sort_keys=True).encode()


class Router:
    def __init__(self) -> None:
        self.routes: list[tuple[str, list[str], Callable[[Request], Response]]] = []

    def add(self, method: str, pattern: str, handler: Callable[[Request], Response]) -> None:
        self.routes.append((method, [p for p in pattern.split("/") if p], handler))

    def dispatch(self, request: Request) -> Response:
        """404 where no path fits, 405 where one does for another method."""
        parts = [unquote(p) for p in request.path.split("/") if p]
        known = False
        for method, pattern, handler in self.routes:
            if len(pattern) != len(parts) or any(a[0] != ":" and a != b for a, b in zip(pattern, parts)):
                continue
            known = True
            if method == request.method:
                request.params = {a[1:]: b for a, b in zip(pattern, parts) if a[0] == ":"}
                return handler(request)
        return Response.error(405, "method_not_allowed", "the path has other methods") if known else Response.error(404, "not_found", "no such path")
