"""The search service: indexes by name, behind routes; and an HTTP server for it."""

from __future__ import annotations

import json
import logging
import os
import queue
import re
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import SparkSession

from tidewater.errors import FailedPrecondition, InvalidArgument
from tidewater.operators.rankers import LinearRanker, ModelRanker, Ranker
from tidewater.operators.search import Options, Searcher
from tidewater.plans.schema import Schema
from tidewater.serving.router import Request, Response, Router
from tidewater.sources.files import Files
from tidewater.streaming.writer import IndexWriter

log = logging.getLogger("tidewater")
NAME = re.compile(r"[A-Za-z0-9_.\-]+\Z")
MAX_SIZE, MAX_TOP_N = 1000, 100_000
MAX_LINE, MAX_HEADERS, MAX_BODY = 8 << 10, 32 << 10, 16 << 20
#: Threads that answer, and connections that may wait for one.
WORKERS, WAITING = 8, 1024


class BadName(InvalidArgument):
    pass


class SearchService:
    """root: a folder with one sub-folder for each index. What opens as an index is served, other folders are passed over."""

    def __init__(self, spark: SparkSession, root: str, max_searches: int = 0, model: Ranker | None = None):
        self.spark, self.root, self.lock = spark, root, threading.Lock()
        self.writers: dict[str, IndexWriter] = {}
        self.linear: dict[str, LinearRanker] = {}
        self.model = model or ModelRanker()
        self.slots = threading.Semaphore(max_searches or max(2 * (os.cpu_count() or 1), 4))
        self.inside, self.peak = 0, 0
        files = Files(spark)
        files.make(root)
        for name in files.names(root):
            if files.exists(f"{root}/{name}/schema.json"):
                try:
                    self.writers[name] = IndexWriter(spark, f"{root}/{name}")
                except Exception as e:  # noqa: BLE001  a broken index must not keep the others from being served
                    log.warning("%s is left out: %s", name, e)
        self.router = Router()
        for method, path, handler in (
            ("GET", "/_health", lambda r: Response(200, {"status": "ok"})),
            ("PUT", "/:index", self.create),
            ("POST", "/:index/_doc", self.add),
            ("POST", "/:index/_refresh", self.refresh),
            ("GET", "/:index/_search", self.search),
            ("GET", "/:index/_ltr", self.ltr),
            ("PUT", "/:index/_ltr/linear", self.set_linear),
        ):
            self.router.add(method, path, handler)

    def handle(self, request: Request) -> Response:
        try:
            return self.router.dispatch(request)
        except BadName as e:
            return Response.error(400, "invalid_index_name", str(e))
        except InvalidArgument as e:
            return Response.error(400, "bad_request", str(e))
        except FailedPrecondition as e:
            return Response.error(503, "unavailable", str(e))
        except Exception as e:  # noqa: BLE001  a request must not end the server
            log.exception("request failed")
            return Response.error(500, "internal", str(e)[:500])

    def _writer(self, request: Request) -> IndexWriter | None:
        with self.lock:
            return self.writers.get(request.params["index"])

    @staticmethod
    def _json(request: Request):
        def refuse(x):
            raise ValueError(f"{x} is not JSON")

        try:
            return json.loads(request.body, parse_constant=refuse)
        except ValueError as e:
            raise InvalidArgument(f"not JSON: {e}") from e

    def create(self, request: Request) -> Response:
        name = request.params["index"]
        if not NAME.match(name) or name in (".", ".."):
            raise BadName("an index name has only letters, digits and _ . -")
        schema = Schema.from_mappings(self._json(request))
        with self.lock:
            if name in self.writers:
                return Response.error(409, "already_exists", "the index exists")
            self.writers[name] = IndexWriter(self.spark, f"{self.root}/{name}", schema)
        return Response(200, {"acknowledged": True, "index": name})

    def add(self, request: Request) -> Response:
        writer = self._writer(request)
        if writer is None:
            return Response.error(404, "not_found", "no such index")
        doc = self._json(request)
        if not isinstance(doc, dict):
            raise InvalidArgument("a document is an object")
        writer.add_document(doc)
        return Response(201, {"result": "created", "_id": doc["_id"], "_index": request.params["index"]})

    def refresh(self, request: Request) -> Response:
        writer = self._writer(request)
        if writer is None:
            return Response.error(404, "not_found", "no such index")
        return Response(200, {"refreshed": True, "generation": writer.refresh()})

    @staticmethod
    def _number(value: str | None, default: int, most: int, name: str) -> int:
        if value is None:
            return default
        if not value.isascii() or not value.isdigit():
            raise InvalidArgument(f"{name} must be a number")
        return min(int(value), most)

    def search(self, request: Request) -> Response:
        writer = self._writer(request)
        if writer is None:
            return Response.error(404, "not_found", "no such index")
        q = request.query
        size = self._number(q.get("size"), 10, MAX_SIZE, "size")
        top_n = self._number(q.get("top_n"), 1000, MAX_TOP_N, "top_n")
        ranker: Ranker | None = None
        if q.get("rerank") in ("true", "1"):
            kind = q.get("ranker", "bm25")
            if kind == "linear":
                ranker = self.linear.get(request.params["index"])
                if ranker is None:
                    raise InvalidArgument("no linear ranker is set")
            elif kind == "catboost":
                ranker = self.model
            elif kind != "bm25":
                raise InvalidArgument(f"unknown ranker {kind}")
        with self.slots:
            with self.lock:
                self.inside += 1
                self.peak = max(self.peak, self.inside)
            try:
                index = writer.reader()
                found = Searcher(index).search(q.get("q", ""), q.get("default_field") or index.schema.default_field(), Options(size, top_n, ranker))
            finally:
                with self.lock:
                    self.inside -= 1
        return Response(200, {"total": found.total_hits, "hits": [{"_id": h.id, "_score": h.score, "_source": json.loads(h.stored_json)} for h in found.hits]})

    def ltr(self, request: Request) -> Response:
        if self._writer(request) is None:
            return Response.error(404, "not_found", "no such index")
        linear = self.linear.get(request.params["index"])
        return Response(200, {"available": ["bm25", "catboost", *(["linear"] if linear else [])], "linear": json.loads(linear.to_json()) if linear else None})

    def set_linear(self, request: Request) -> Response:
        if self._writer(request) is None:
            return Response.error(404, "not_found", "no such index")
        self.linear[request.params["index"]] = LinearRanker.from_json(request.body.decode("utf-8", "replace"))
        return Response(200, {"acknowledged": True})

    def stop(self) -> None:
        for w in self.writers.values():
            w.refresh()
            w.close()


class PooledServer(HTTPServer):
    """Connections wait in a queue for one of a fixed number of threads; what doesn't fit in the queue is answered with 503 at once."""

    request_queue_size = 128

    def __init__(self, address, handler, workers: int, waiting: int):
        super().__init__(address, handler)
        self.waiting: queue.Queue = queue.Queue(waiting)
        self.workers = [threading.Thread(target=self._work, daemon=True) for _ in range(workers)]
        for t in self.workers:
            t.start()

    def process_request(self, request, client_address) -> None:
        try:
            self.waiting.put_nowait((request, client_address))
        except queue.Full:
            raw = Response.error(503, "overloaded", "too many requests are waiting").encoded()
            try:
                request.sendall(b"HTTP/1.0 503 Service Unavailable\r\nContent-Type: application/json\r\nContent-Length: %d\r\nConnection: close\r\n\r\n%b" % (len(raw), raw))
            except OSError:
                pass
            self.shutdown_request(request)

    def _work(self) -> None:
        while (got := self.waiting.get()) is not None:
            request, client_address = got
            try:
                self.finish_request(request, client_address)
            except Exception:  # noqa: BLE001  a client must not end a worker
                self.handle_error(request, client_address)
            finally:
                self.shutdown_request(request)

    def handle_error(self, request, client_address) -> None:
        log.debug("connection from %s failed", client_address, exc_info=True)

    def server_close(self) -> None:
        super().server_close()
        for _ in self.workers:
            try:
                self.waiting.put_nowait(None)
            except queue.Full:
                break


def serve(service: SearchService, host: str = "127.0.0.1", port: int = 8080, workers: int = WORKERS, waiting: int = WAITING) -> PooledServer:
    """A server that isn't running yet: call serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        timeout = 60  # seconds that a client may be silent

        def _answer(self) -> None:
            if len(self.requestline) > MAX_LINE:
                return self._refuse(414, "the request line is too long")
            if sum(len(k) + len(v) for k, v in self.headers.items()) > MAX_HEADERS:
                return self._refuse(413, "the headers are too long")
            if self.headers.get("Transfer-Encoding"):
                return self._refuse(411, "a length is needed")
            length = self.headers.get("Content-Length", "0")
            if not (length.isascii() and length.isdigit()):
                return self._refuse(400, "bad Content-Length")
            if int(length) > MAX_BODY:
                return self._refuse(413, "the body is too long")
            self._send(service.handle(Request(self.command, self.path, self.rfile.read(int(length)), dict(self.headers))))

        def _refuse(self, status: int, reason: str) -> None:
            self._send(Response.error(status, "bad_request", reason))

        def send_error(self, code, message=None, explain=None) -> None:  # what the library itself refuses
            self._refuse(int(code), message or "bad request")

        def _send(self, response: Response) -> None:
            raw = response.encoded()
            self.send_response(response.status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.send_header("Connection", "close")
            self.end_headers()
            self.wfile.write(raw)
            self.close_connection = True

        do_GET = do_PUT = do_POST = do_DELETE = do_HEAD = _answer

        def log_message(self, form: str, *args) -> None:
            log.debug(form, *args)

    return PooledServer((host, port), Handler, workers, waiting)
