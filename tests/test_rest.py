"""The REST stream against a server of its own: pages, pauses, watermarks, lost batches, allowances, comments."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from sedimenta.sources import rest as R


class Stub:
    """A listing, newest first, and threads; remembers what was asked."""

    def __init__(self):
        self.items, self.left, self.status, self.asked, self.threads = [], 1000, 200, [], {}
        stub = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                at = urlparse(self.path)
                stub.asked.append(self.path)
                head, body = {"x-ratelimit-remaining": str(stub.left), "x-ratelimit-reset": "0"}, []
                if at.path.endswith("/comments"):
                    body = stub.threads.get(at.path.split("/repos/o/r/")[1], [])
                elif stub.status < 400:
                    start = int(parse_qs(at.query).get("after", ["0"])[0])
                    body = stub.items[start : start + 100]
                    if start + 100 < len(stub.items):
                        head["link"] = f'<{stub.base}{at.path}?after={start + 100}>; rel="next", <{stub.base}/last>; rel="last"'
                self.send_response(stub.status)
                for k, v in head.items():
                    self.send_header(k, v)
                self.end_headers()
                self.wfile.write(json.dumps(body).encode())

            def log_message(self, *args):
                pass

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.base = f"http://127.0.0.1:{self.http.server_port}"
        threading.Thread(target=self.http.serve_forever, daemon=True).start()

    def fill(self, total: int, day: int = 1):
        self.items = [{"number": total - k, "updated_at": f"2026-01-{day:02d}T{23 - k // 60:02d}:{59 - k % 60:02d}:00Z", "title": f"t{total - k}", "comments": k % 3, **({"pull_request": {}} if k % 5 == 0 else {})} for k in range(total)]


@pytest.fixture
def stub():
    s = Stub()
    yield s
    s.http.shutdown()


PATH = "/repos/o/r/issues"


def test_runs_pause_and_go_on(stub):
    stub.fill(450)
    server = R.Server(stub.base)
    a = R.crawl(server, PATH, R.Place(), 2)
    assert len(a.items) == 200 and a.note and "after=200" in a.place.next and a.place.covered is None
    b = R.crawl(server, PATH, a.place, 2)
    c = R.crawl(server, PATH, b.place, 2)
    assert c.note is None and c.place == R.Place(stub.items[0]["updated_at"])
    assert [x["number"] for x in a.items + b.items + c.items] == list(range(450, 0, -1))
    assert "state=all" in stub.asked[0] and R.crawl(server, PATH, c.place, 2) == R.Run([], c.place, None)


def test_stops_at_what_is_covered(stub):
    stub.fill(450)
    run = R.crawl(R.Server(stub.base), PATH, R.Place(stub.items[4]["updated_at"]))
    assert run.note is None and [x["number"] for x in run.items] == [450, 449, 448, 447] and len(stub.asked) == 1


def test_allowance_errors_and_bare_links(stub):
    stub.fill(450)
    stub.left = 2
    run = R.crawl(R.Server(stub.base), PATH, R.Place())
    assert "rate limit" in run.note and "after=100" in run.place.next and len(run.items) == 100
    stub.left, stub.status = 0, 403
    assert R.crawl(R.Server(stub.base), PATH, R.Place("2025-01-01T00:00:00Z")).place == R.Place("2025-01-01T00:00:00Z")
    assert R.crawl(R.Server(stub.base), PATH, run.place).place == run.place
    stub.left, stub.status = 9, 404
    assert "not found" in R.crawl(R.Server(stub.base), PATH, R.Place()).note
    assert R.Place.of({"covered": "x", "next": "/repos/o/r/pulls", "newest": "y"}) == R.Place("x")
    waits = []
    gone = R.Server("http://127.0.0.1:9", sleep=waits.append)
    assert "network error" in R.crawl(gone, PATH, R.Place()).note and waits == [1, 2]


def start(spark, stub, folder, sink):
    stream = spark.readStream.format("rest_listing").options(base=stub.base, path=PATH, pages="2", spool=f"{folder}/spool").load()
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def test_stream_loses_and_repeats_nothing(spark, stub, tmp_path):
    """A batch is lost after it was planned, and the server's list moves on before the query starts again."""
    R.register(spark)
    stub.fill(250)
    got, fail = [], [True]

    def sink(df, n):
        rows = df.collect()
        if fail and fail.pop():
            raise RuntimeError("lost")
        got.append([(r.number, r.title, r.is_pull) for r in rows])

    with pytest.raises(Exception, match="lost"):
        start(spark, stub, tmp_path, sink).awaitTermination()
    first = list(stub.items)
    for x in stub.items:
        x["title"] = "changed"
    for _ in range(3):
        start(spark, stub, tmp_path, sink).awaitTermination()
    rows = [r for batch in got for r in batch]
    assert [n for n, _, _ in rows] == [x["number"] for x in first]
    assert {t for _, t, _ in rows[:200]} == {f"t{n}" for n, _, _ in rows[:200]}, "the lost batch is read as it was planned"
    assert json.loads((tmp_path / "spool" / "status.json").read_text())["whole"]
    stub.items = [{"number": 999, "updated_at": "2026-02-01T00:00:00Z", "title": "new"}, *stub.items]
    for _ in range(2):
        start(spark, stub, tmp_path, sink).awaitTermination()
    assert [r for batch in got for r in batch][len(rows) :] == [(999, "new", False)]
    listing = spark.createDataFrame([(5, "2", True, 4), (4, "1", False, 1), (3, "1", True, None)], "number long, updated_at string, is_pull boolean, comments long")
    assert [r.number for r in R.issues(listing).collect()] == [4]
    assert {tuple(r) for r in R.pull_comment_counts(listing).collect()} == {(5, 4), (3, 0)}


def test_comments_within_a_budget(spark, stub):
    for at in ("issues/7", "pulls/7", "issues/3", "issues/2"):
        stub.threads[f"{at}/comments"] = [{"id": int(at[-1]) * 10 + k, "user": {"login": "ann"}, "body": f"c{k}", "path": "a.py" if "pulls" in at else None} for k in range(2)]
    targets = spark.createDataFrame([(1, "issue", 3, False), (0, "pull_request", 7, True), (1, "issue", 2, False)], "tier int, parent_type string, number long, review boolean")
    rows = R.comments(targets, stub.base, "o/r", 3).collect()
    assert [(r.parent_type, r.number) for r in rows if r.what == "done"] == [("pull_request", 7), ("issue", 3)]
    assert {(r.number, r.kind, r.path) for r in rows if r.what == "comment"} == {(7, "conversation", None), (7, "review", "a.py"), (3, "conversation", None)}
    assert [r.note for r in rows if r.what == "note"] == ["budget of 3 requests used"] and len(stub.asked) == 3
    stub.left, stub.status = 0, 403
    rows = R.comments(targets, stub.base, "o/r").collect()
    assert [(r.what, r.number) for r in rows] == [("note", 7)]
    stub.left, stub.status = 50, 410  # closed threads are passed over
    assert {r.what for r in R.comments(targets, stub.base, "o/r").collect()} == {"done"}
    assert R.comments(targets.limit(0), stub.base, "o/r").collect() == []
