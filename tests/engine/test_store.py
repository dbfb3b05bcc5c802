import json
import math
import os
import socket
import threading
import urllib.error
import urllib.request

import pytest

from tidewater import cli
from tidewater.errors import Corruption, FailedPrecondition, InvalidArgument
from tidewater.operators.search import Searcher
from tidewater.plans.schema import Schema
from tidewater.serving import load, report
from tidewater.serving.router import Request, Response, Router
from tidewater.serving.service import SearchService, serve
from tidewater.sources import documents, store
from tidewater.sources.files import Files
from tidewater.streaming.writer import IndexWriter

SCHEMA = {"mappings": {"title": {"stored": True}, "body": {"store_token_weights": True}, "n": {}}, "store_doc_quality": True}


def total(index, text, field="body"):
    return Searcher(index).search(text, field).total_hits


def test_refresh_snapshot_and_reopen(spark, tmp_path):
    root = str(tmp_path / "i")
    with pytest.raises(FailedPrecondition):
        IndexWriter(spark, root)
    w = IndexWriter(spark, root, Schema.from_mappings(SCHEMA))
    assert w.refresh() == 0 and total(w.reader(), "") == 0
    w.add_document({"_id": "a", "body": "needle in haystack", "title": "T one", "n": 42, "ignored": "needle"})
    w.add_document({"_id": "b", "body": "needle", "n": True, "body_weights": [2.0], "_quality": 0.75})
    for bad in ({}, {"_id": ""}, {"_id": 3}):
        with pytest.raises(InvalidArgument):
            w.add_document(bad)
    for raw in ("{", "[1]", "3"):
        with pytest.raises(InvalidArgument):
            w.add_document({"_id": "z"}, raw)
    before = w.reader()
    assert total(before, "needle") == 0
    assert w.refresh() == 1 and w.refresh() == 1
    after = w.reader()
    assert total(before, "needle") == 0 and total(after, "needle") == 2
    assert total(after, "n:42") == 1 and total(after, "n:000000") == 1 and total(after, "n:true") == 1
    found = Searcher(after).search("needle title:one OR needle", "body")
    assert json.loads(next(h.stored_json for h in found.hits if h.id == "a")) == {"_id": "a", "title": "T one"}
    p = after.postings.where("term = 'needle'").join(after.docs, ["seg", "doc"]).select("_id", "weight_q8", "quality").collect()
    assert {(r._id, r.weight_q8, r.quality) for r in p} == {("a", 32, 0.0), ("b", 64, 0.75)}
    w.add_document({"_id": "a", "body": "needle again"})
    w.close()
    for late in (lambda: w.add_document({"_id": "z"}), w.refresh, lambda: w.land(spark.createDataFrame([("{}",)], "value string"))):
        with pytest.raises(FailedPrecondition):
            late()
    assert total(w.reader(), "needle") == 2
    again = IndexWriter(spark, root)
    assert total(again.reader(), "needle") == 2 and again.refresh() == 2 and total(again.reader(), "needle") == 3
    assert total(after, "needle") == 2 and os.listdir(f"{root}/landing") == []


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    w = IndexWriter(spark, str(tmp_path / "i"), Schema.from_mappings(SCHEMA))
    w.add_document({"_id": "a", "body": "x"})
    w.refresh()
    df = spark.createDataFrame([('{"_id": "b", "body": "x"}', "f")], "value string, file string")
    w._batch(df, w.manifest.batches[-1])
    assert w.generation == 1 and total(w.reader(), "x") == 1


def test_torn_and_odd_lines(spark, tmp_path):
    w = IndexWriter(spark, str(tmp_path / "i"), Schema.from_mappings(SCHEMA))
    with open(f"{w.root}/landing/{1:020d}.jsonl", "w") as f:
        f.write('{"_id": "a", "body": "x"}\n\nnot json\n[1]\n{"body": "x"}\n{"_id": "b", "body": ["x"], "title": null, "n": 1.5}\n{"_id": "c", "bo')
    w.refresh()
    assert sorted(r._id for r in w.reader().docs.collect()) == ["a", "b"] and total(w.reader(), "x") == 1


def test_documents_of_several_lines(spark, tmp_path):
    w = IndexWriter(spark, str(tmp_path / "i"), Schema.from_mappings(SCHEMA))
    docs = [{"_id": f"d{i}", "body": "one\ntwo \u2028 é\r three", "n": 1e2} for i in range(2)]
    w.add_document(docs[0], json.dumps(docs[0], indent=1))
    w.add_document(docs[1], json.dumps(docs[1], indent="\t").replace("\n", "\r\n").replace("100.0", "1e400"))
    w.add_document({"_id": "plain", "body": "two"})
    w.refresh()
    assert total(w.reader(), "two") == 3 and total(w.reader(), "n:100 OR three") == 2


def test_segments_are_validated(spark, tmp_path):
    import shutil

    w = IndexWriter(spark, str(tmp_path / "i"), Schema.from_mappings(SCHEMA))
    for i in range(2):
        w.add_document({"_id": f"d{i}", "body": "x"})
        w.refresh()
    store.open_index(spark, w.root)
    good = store.load_manifest(Files(spark), w.root)
    assert good.segments[0]["fingerprint"] == "standard:v1+keyword:v1"
    for change in ({"doc_count": 2}, {"fingerprint": "standard:v0+keyword:v1"}, {"stem": "seg-0"}):
        bad = store.Manifest(good.generation, [good.segments[0] | change, good.segments[1]], good.batches, good.next_seg)
        store.save_manifest(Files(spark), w.root, bad)
        for opened in (store.open_index, IndexWriter):
            with pytest.raises(Corruption):
                opened(spark, w.root)
    store.save_manifest(Files(spark), w.root, store.Manifest(good.generation, [{k: v for k, v in s.items() if k != "fingerprint"} for s in good.segments], [], good.next_seg))
    assert total(store.open_index(spark, w.root), "x") == 2
    shutil.rmtree(f"{w.root}/segments/{good.segments[1]['stem']}/postings")
    with pytest.raises(Corruption):
        store.open_index(spark, w.root)


def test_an_analyzer_of_ones_own(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidewater.functions import analysis

    with pytest.raises(ValueError):
        analysis.register("standard", analysis.ANALYZERS["keyword"])
    analysis.register("commas", analysis.Analyzer(lambda c: F.split(c, ","), lambda t: t.split(","), "commas:v1"))
    try:
        schema = Schema.from_mappings({"mappings": {"tags": {"analyzer": "commas"}, "body": {}}})
        assert schema.fingerprint() == "standard:v1+keyword:v1+commas:v1"
        w = IndexWriter(spark, str(tmp_path / "i"), schema)
        w.add_document({"_id": "a", "tags": "The one,of two", "body": "The one"})
        w.refresh()
        assert total(w.reader(), 'tags:"of two"') == 1 and total(w.reader(), "tags:one") == 0 and total(w.reader(), "one") == 1
    finally:
        del analysis.ANALYZERS["commas"]
    with pytest.raises(Corruption):
        store.open_index(spark, w.root)


def test_order_of_arrival_decides_ties(spark, tmp_path):
    w = IndexWriter(spark, str(tmp_path / "i"), Schema.from_mappings(SCHEMA))
    for i in (5, 3, 4, 1):
        w.add_documents([{"_id": f"d{i}", "body": "same"}, {"_id": f"e{i}", "body": "same"}])
    w.refresh()
    assert [h.id for h in Searcher(w.reader()).search("same", "body", size=5).hits] == ["d5", "e5", "d3", "e3", "d4"]


def test_manifest(spark, tmp_path):
    files = Files(spark)
    assert store.load_manifest(files, str(tmp_path)).generation == 0
    m = store.Manifest(3, [{"seg": 0, "stem": "s", "doc_count": 2}], [7], 1)
    store.save_manifest(files, str(tmp_path), m)
    assert store.load_manifest(files, str(tmp_path)) == m
    for bad in ("{", "{}", '{"version": 1}', '{"version": 2, "generation": "x"}'):
        (tmp_path / "manifest.json").write_text(bad)
        with pytest.raises(Corruption):
            store.load_manifest(files, str(tmp_path))


def test_files(spark, tmp_path):
    files, at = Files(spark), f"file://{tmp_path}/a b"
    files.make(at)
    files.write(f"{at}/x", "one é")
    files.write(f"{at}/x", "two")
    files.write(f"{at}/.hidden", "")
    assert files.read(f"{at}/x") == "two" and files.names(at) == ["x"] and files.is_folder(at) and not files.is_folder(f"{at}/x")
    files.rename(f"{at}/x", f"{at}/y")
    assert files.exists(f"{at}/y") and not files.exists(f"{at}/x") and files.names(f"{at}/none") == []
    files.delete(at)
    assert not files.exists(at)


def test_sources(spark, tmp_path):
    (tmp_path / "j").write_text('{"query": "q", "doc_id": "a", "label": 2.9}\n{"query": "q"}\nx\n{"query": "q", "doc_id": "a", "label": 1, "query_id": 4}\n')
    assert [(r.query, r.doc_id, r.label, r.query_id) for r in documents.read_judgments(spark, str(tmp_path / "j")).orderBy("line").collect()] == [("q", "a", 2, None), ("q", "a", 1, 4)]
    assert documents.judgment_maps(documents.read_judgments(spark, str(tmp_path / "j"))).first().labels == {"a": 1}
    (tmp_path / "q").write_text("# no\n\none two\ntitle\tthree\n")
    assert [(r.field, r.query) for r in documents.read_queries(spark, str(tmp_path / "q")).collect()] == [(None, "one two"), ("title", "three")]
    (tmp_path / "c").write_text('{"id": "1", "t": "x"}\n')
    assert documents.read_corpus(spark, str(tmp_path / "c")).columns == ["_id", "t"]
    (tmp_path / "c2").write_text('{"t": "x"}\n')
    with pytest.raises(InvalidArgument):
        documents.read_corpus(spark, str(tmp_path / "c2"))


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "m.json").write_text(json.dumps({"mappings": {"title": {"stored": True}, "body": {}}}))
    (tmp_path / "d.jsonl").write_text("\n".join(json.dumps({"_id": f"d{i}", "title": "shared", "body": f"word{i} shared", "_quality": 1}) for i in range(4)) + "\nbroken\n")
    root = str(tmp_path / "i")
    assert cli.main(["index", "--index", root, "--mapping", str(tmp_path / "m.json"), "--docs", str(tmp_path / "d.jsonl")], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"generation": 1, "documents": 4}
    cli.main(["search", "--index", root, "--size", "2", "shared", "OR", "word3"], spark)
    out = json.loads(capsys.readouterr().out)
    assert out["total"] == 4 and [h["_id"] for h in out["hits"]] == ["d3", "d0"]
    (tmp_path / "j").write_text('{"query": "shared", "doc_id": "d1", "label": 1}\n{"query": "shared", "doc_id": "d2", "label": 0}\n')
    cli.main(["export-features", "--index", root, "--judgments", str(tmp_path / "j"), "--out", str(tmp_path / "pool")], spark)
    cli.main(["train", "--pool", str(tmp_path / "pool"), "--out", str(tmp_path / "w.json")], spark)
    assert len(json.loads((tmp_path / "w.json").read_text())["weights"]) == 19


def test_router():
    r = Router()
    r.add("GET", "/:i/_search", lambda q: Response(200, q.params | q.query))
    assert r.dispatch(Request("GET", "/a%20b/_search?q=x+y&q=z%2")).body == {"i": "a b", "q": "z%2"}
    assert r.dispatch(Request("PUT", "/a/_search")).status == 405 and r.dispatch(Request("GET", "/a")).status == 404


def test_service_over_http(spark, tmp_path, capsys):
    os.makedirs(tmp_path / "root" / "not_an_index")
    service = SearchService(spark, str(tmp_path / "root"))
    server = serve(service, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(method, path, body=None):
        raw = json.dumps(body).encode() if isinstance(body, (dict, list)) else body
        try:
            with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", raw, method=method)) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        assert call("GET", "/_health") == (200, {"status": "ok"})
        assert call("PUT", "/a%2Fb", {"mappings": {}})[0] == 400 and call("PUT", "/x", b"{")[0] == 400
        assert call("PUT", "/a%2Fb", {"mappings": {}})[1]["error"]["type"] == "invalid_index_name" and call("PUT", "/x", b"{")[1]["error"]["type"] == "bad_request"
        assert set(call("GET", "/no/_search?q=x")[1]["error"]) == {"type", "reason"} and call("GET", "/no/_search?q=x")[1]["error"]["type"] == "not_found"
        assert call("PUT", "/x", SCHEMA)[0] == 200 and call("PUT", "/x", SCHEMA)[1]["error"]["type"] == "already_exists" and call("PUT", "/x", SCHEMA)[0] == 409
        assert call("POST", "/y/_doc", {"_id": "a"})[0] == 404 and call("POST", "/x/_doc", {"body": "no id"})[0] == 400 and call("POST", "/x/_doc", b"[1]")[0] == 400
        assert call("POST", "/x/_doc", {"_id": "a", "body": "river river river river", "title": "A", "_quality": 0.1})[0] == 201
        assert call("POST", "/x/_doc", {"_id": "b", "body": "river", "title": "B", "_quality": 0.9})[0] == 201
        assert call("GET", "/x/_search?q=river")[1]["total"] == 0
        assert call("POST", "/x/_refresh")[1] == {"refreshed": True, "generation": 1}
        status, got = call("GET", "/x/_search?q=river&size=5")
        assert status == 200 and got["total"] == 2 and [h["_id"] for h in got["hits"]] == ["a", "b"] and got["hits"][0]["_source"] == {"_id": "a", "title": "A"}
        assert call("GET", "/x/_search?q=river&size=x")[0] == 400 and call("GET", "/x/_search?q=(")[0] == 400
        assert call("GET", "/x/_search?q=river&rerank=true&ranker=linear")[0] == 400 and call("GET", "/x/_search?q=river&ranker=nope")[0] == 200 and call("GET", "/x/_search?q=river&rerank=1&ranker=nope")[0] == 400
        weights = [0.0] * 19
        weights[15] = 100.0
        assert call("PUT", "/x/_ltr/linear", {"weights": [1]})[0] == 400 and call("PUT", "/x/_ltr/linear", {"weights": weights})[0] == 200
        assert call("GET", "/x/_ltr")[1]["available"] == ["bm25", "catboost", "linear"]
        assert [h["_id"] for h in call("GET", "/x/_search?q=river&rerank=true&ranker=linear")[1]["hits"]] == ["b", "a"]
        (tmp_path / "q").write_text("river\ntitle\tA\n")
        load.main(["--url", f"http://127.0.0.1:{server.server_port}", "--index", "x", "--queries", str(tmp_path / "q"), "--clients", "2", "--seconds", "2", "--warm-up", "0"], spark)
        out = json.loads(capsys.readouterr().out.splitlines()[-1])
        assert out["requests"] == out["n"] > 0 and out["errors"] == 0 and 0 < out["p50"] <= out["p99"]
        assert call("DELETE", "/x")[1]["error"]["type"] == "method_not_allowed" and call("GET", "/x/y/z")[1]["error"]["type"] == "not_found"
        engine = report.http_engine(f"http://127.0.0.1:{server.server_port}", "x")
        assert engine("river", "body", 1) == ["a"] and engine("title:B", "title", 5) == ["b"]
    finally:
        server.shutdown()
        server.server_close()
    assert set(SearchService(spark, str(tmp_path / "root")).writers) == {"x"}


def test_limits_of_http(spark, tmp_path):
    service = SearchService(spark, str(tmp_path / "root"))
    server = serve(service, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def raw(text):
        with socket.create_connection(("127.0.0.1", server.server_port), timeout=20) as c:
            c.sendall(text)
            got = b""
            while part := c.recv(65536):
                got += part
        head, _, body = got.partition(b"\r\n\r\n")
        return int(head.split()[1]), json.loads(body)["error"]["type"]

    try:
        assert raw(b"GET /" + b"a" * 9000 + b" HTTP/1.1\r\n\r\n") == (414, "bad_request")
        assert raw(b"GET /_health HTTP/1.1\r\nX: " + b"a" * 33_000 + b"\r\n\r\n")[0] == 413
        assert raw(b"PUT /x HTTP/1.1\r\nTransfer-Encoding: chunked\r\n\r\n")[0] == 411
        assert raw(b"PUT /x HTTP/1.1\r\nContent-Length: -5\r\n\r\n")[0] == 400
        assert raw(b"PUT /x HTTP/1.1\r\nContent-Length: 99999999\r\n\r\n")[0] == 413
        assert raw(b"BREW /x HTTP/1.1\r\n\r\n")[0] == 501
    finally:
        server.shutdown()
        server.server_close()


def test_a_full_queue_is_answered_at_once(spark, tmp_path):
    service = SearchService(spark, str(tmp_path / "root"))
    go, started = threading.Event(), threading.Event()

    def slow(request):
        started.set()
        go.wait(20)
        return Response(200, {})

    service.router.add("GET", "/slow", slow)
    server = serve(service, port=0, workers=1, waiting=1)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    status = []

    def call():
        try:
            with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/slow") as r:
                status.append(r.status)
        except urllib.error.HTTPError as e:
            status.append((e.code, json.loads(e.read())["error"]["type"]))

    try:
        first = threading.Thread(target=call)
        first.start()
        assert started.wait(20)
        second = threading.Thread(target=call)
        second.start()
        while server.waiting.empty():
            pass
        call()
        assert status == [(503, "overloaded")]
        go.set()
        first.join(20)
        second.join(20)
        assert status == [(503, "overloaded"), 200, 200]
    finally:
        server.shutdown()
        server.server_close()


def test_numbers_that_json_has_not():
    assert json.loads(Response(200, {"a": float("nan"), "b": [1.5, float("inf")], "c": "é"}).encoded()) == {"a": None, "b": [1.5, None], "c": "é"}


def test_reports(spark, tmp_path, capsys):
    w = IndexWriter(spark, str(tmp_path / "i"), Schema.from_mappings(SCHEMA))
    w.add_documents([{"_id": f"d{i}", "title": f"T{i}", "body": "river " * (i + 1)} for i in range(4)])
    w.refresh()
    lines = [{"query": "river", "doc_id": "d3", "label": 2}, {"query": "river", "doc_id": "d0", "label": 1}, {"query": "title:t1", "doc_id": "d1", "label": 1}, {"query": "none", "doc_id": "d1", "label": 1}]
    (tmp_path / "j").write_text("\n".join(map(json.dumps, lines)))
    judged = documents.read_judgments(spark, str(tmp_path / "j"))
    own = report.engine(w.reader(), "body")
    got = report.quality_report(spark, own, judged)
    ideal = 3 + 1 / math.log2(3)
    want = {"queries": 3, "ndcg@10": ((3 + 1 / math.log2(5)) / ideal + 1 + 0) / 3, "p@5": (2 / 5 + 1 / 5) / 3, "mrr": 2 / 3}
    assert got == pytest.approx(want)
    cli.main(["quality", "--index", w.root, "--judgments", str(tmp_path / "j"), "--field", "body"], spark)
    assert json.loads(capsys.readouterr().out) == pytest.approx(want)
    both = report.compare(spark, lambda q, f, n: [], own, judged, clients=1, seconds=1.0, warm_up=0.0)
    assert both["ahead"] == {"quality": 1, "load": 0} and both["difference"]["mrr"] == pytest.approx(-2 / 3) and both["quality"][0]["queries"] == 3
    assert report.field_of("a:b") == "a" and report.field_of("a:b c") is None and report.field_of("b") is None
