"""A REST listing of issues or pull requests as a stream, and the comments of a frame of them.

The listing is read newest first, a hundred to a page. A micro-batch is one run of some pages: it ends at the newest change that an earlier
crawl has covered, at the end of the list, at its number of pages, or when the server's allowance is nearly used; the offset then holds the link at which
the next run goes on. What a run has fetched is written to `spool` before its offset is known to Spark, so a batch that is planned and lost
is read again as it was, whatever the server says by then; the file goes when the batch is committed."""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from datetime import datetime
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

# The query of a crawl's first page, and how often and for how long a request is tried again.
FIRST = {"state": "all", "sort": "updated", "direction": "desc", "per_page": "100"}
WAITS = (1, 2)
#: Requests of the allowance that are left to others; pages of a run, of a thread, requests of a run of comments.
SPARE, RUN_PAGES, THREAD_PAGES, COMMENT_REQUESTS = 3, 10, 3, 200
ITEM = "number long, updated_at string, is_pull boolean, comments long, title string, body string, state string, author string, created_at string, closed_at string, merged_at string, merge_commit_sha string, labels array<string>, url string"
COMMENT = "parent_type string, number long, what string, comment_id long, kind string, author string, body string, path string, created_at string, url string, note string"


class Unreachable(Exception):
    """The server couldn't be reached, however often it was tried."""


class Reply(NamedTuple):
    status: int
    items: list
    next: str | None
    left: int
    resets: str | None

    @property
    def refused(self) -> bool:
        return self.status in (403, 429) and self.left == 0

    def limit_note(self) -> str:
        at = datetime.fromtimestamp(int(self.resets)).strftime("%H:%M") if self.resets else "later"
        return f"rate limit reached (resets at {at}); the next run goes on from here"


class Server:
    """GET requests that are tried again when the connection fails, never when the server answers."""

    def __init__(self, base: str, token: str | None = None, sleep: Callable[[float], None] = time.sleep, timeout: float = 30):
        self.base, self.sleep, self.timeout = base.rstrip("/"), sleep, timeout
        self.headers = {"Accept": "application/vnd.github+json", "X-GitHub-Api-Version": "2022-11-28"} | ({"Authorization": f"Bearer {token}"} if token else {})

    def get(self, url: str, query: dict | None = None) -> Reply:
        at = url if url.startswith("http") else self.base + url
        if query:
            at += "?" + urllib.parse.urlencode(query)
        for wait in (*WAITS, None):
            try:
                with urllib.request.urlopen(urllib.request.Request(at, headers=self.headers), timeout=self.timeout) as r:
                    return self._reply(r.status, r.headers, r.read())
            except urllib.error.HTTPError as e:
                return self._reply(e.code, e.headers, b"[]")
            except OSError as e:
                if wait is None:
                    raise Unreachable(f"network error: {e}") from e
                self.sleep(wait)
        raise AssertionError

    @staticmethod
    def _reply(status: int, headers, body: bytes) -> Reply:
        links = dict(re.findall(r'<([^>]*)>;\s*rel="(\w+)"', headers.get("link") or ""))
        links = {rel: at for at, rel in links.items()}
        return Reply(status, json.loads(body or b"[]") if status < 400 else [], links.get("next"), int(headers.get("x-ratelimit-remaining") or 1000), headers.get("x-ratelimit-reset"))


class Place(NamedTuple):
    """Where a crawl stands. covered: newest change of the last whole crawl; next: link of an unfinished one, which will cover `newest`."""

    covered: str | None = None
    next: str | None = None
    newest: str | None = None

    @classmethod
    def of(cls, offset: dict) -> Place:
        """From a stored offset. A link that isn't a whole address has lost its query, so that crawl begins anew."""
        p = cls(**{k: offset.get(k) for k in cls._fields})
        return p if p.next is None or p.next.startswith("http") else cls(p.covered)


class Run(NamedTuple):
    items: list
    place: Place
    note: str | None


def _time(text: str) -> datetime:
    return datetime.fromisoformat(text.replace("Z", "+00:00"))


def crawl(server: Server, path: str, place: Place, pages: int = RUN_PAGES) -> Run:
    """One run over a listing, from `place` on: what it found, where the next one goes on, and why it stopped early (null if the crawl is whole)."""
    until = _time(place.covered) if place.covered else None
    found, link, newest = [], place.next, place.newest if place.next else None

    def paused(note: str) -> Run:
        return Run(found, Place(place.covered, link, newest) if link else Place(place.covered), note)

    for _ in range(pages):
        try:
            reply = server.get(link) if link else server.get(path, FIRST)
        except Unreachable as e:
            return paused(str(e))
        if reply.refused:
            return paused(reply.limit_note())
        if reply.status == 404:
            return Run(found, place, "not found on the server, or private")
        if reply.status >= 400:
            return paused(f"the server answered {reply.status}")
        if newest is None and reply.items:
            newest = reply.items[0]["updated_at"]
        fresh = [x for x in reply.items if until is None or _time(x["updated_at"]) > until]
        found += fresh
        if len(fresh) < len(reply.items) or reply.next is None:
            return Run(found, Place(newest or place.covered), None)
        link = reply.next
        if reply.left <= SPARE:
            return paused(reply.limit_note())
    return paused(f"paused after {pages} pages")


def _row(x: dict) -> tuple:
    who = (x.get("user") or {}).get("login")
    names = [label["name"] if isinstance(label, dict) else label for label in x.get("labels") or []]
    merged = x.get("merged_at") or (x.get("pull_request") or {}).get("merged_at")
    return (x["number"], x["updated_at"], "pull_request" in x, x.get("comments"), x.get("title"), x.get("body"), x.get("state"), who, x.get("created_at"), x.get("closed_at"), merged, x.get("merge_commit_sha"), names, x.get("html_url"))


class _Listing(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.server = Server(options["base"], options.get("token"))
        self.path, self.pages, self.spool = options["path"], int(options.get("pages", RUN_PAGES)), options["spool"]

    def initialOffset(self) -> dict:
        return Place()._asdict()

    def _file(self, start: dict) -> str:
        name = hashlib.sha256(json.dumps([self.path, *Place.of(start)]).encode()).hexdigest()[:32]
        return os.path.join(self.spool, f"{name}.json")

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        run = crawl(self.server, self.path, Place.of(start), self.pages)
        end = run.place._asdict()
        os.makedirs(self.spool, exist_ok=True)
        if end != start:
            self._put(self._file(start), {"end": end, "items": run.items})
        self._put(os.path.join(self.spool, "status.json"), {"whole": run.note is None, "note": run.note, "place": end})
        return iter([_row(x) for x in run.items] if end != start else []), end

    @staticmethod
    def _put(path: str, value: dict) -> None:
        part = f"{path}.{os.getpid()}.part"
        with open(part, "w") as f:
            json.dump(value, f)
        os.replace(part, path)

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        with open(self._file(start)) as f:
            kept = json.load(f)
        if kept["end"] != end:
            raise RuntimeError("the spooled run isn't the one that was planned")
        return iter([_row(x) for x in kept["items"]])

    def commit(self, end: dict) -> None:
        for name in os.listdir(self.spool) if os.path.isdir(self.spool) else ():
            if re.fullmatch(r"[0-9a-f]{32}\.json", name):
                path = os.path.join(self.spool, name)
                with open(path) as f:
                    if json.load(f)["end"] == end:
                        os.remove(path)


class RestListing(DataSource):
    """Stream `rest_listing`. Options: base (address of the server), path (of the listing), spool (a folder that outlives the query and that the
    driver's machine and its successor share), pages (of a run), token."""

    @classmethod
    def name(cls) -> str:
        return "rest_listing"

    def schema(self) -> str:
        return ITEM

    def simpleStreamReader(self, schema):
        return _Listing(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RestListing)


def issues(listing: DataFrame) -> DataFrame:
    """The listing of issues also has pull requests; these are the others."""
    return listing.filter("not is_pull")


def pull_comment_counts(listing: DataFrame) -> DataFrame:
    """(number, comments) of the pull requests that a listing of issues has: only there are their conversations counted."""
    return listing.filter("is_pull").select("number", F.coalesce("comments", F.lit(0)).alias("comments"))


def _threads(server: Server, repo: str, targets: Iterator[tuple], most: int) -> Iterator[tuple]:
    """Comments of each target in turn, a `done` row for each target that is whole, and a `note` row if the run stopped early."""
    used = 0
    for kind, number, review in targets:
        for what, folder in (("conversation", "issues"), ("review", "pulls"))[: 1 + bool(review)]:
            link, query = f"/repos/{repo}/{folder}/{number}/comments", {"per_page": "100"}
            for _ in range(THREAD_PAGES):
                note = None
                if used >= most:
                    note, reply = f"budget of {most} requests used", None
                else:
                    try:
                        reply, used = server.get(link, query), used + 1
                        note = reply.limit_note() if reply.refused else None
                    except Unreachable as e:
                        note, reply = str(e), None
                for x in reply.items if reply else ():
                    yield (kind, number, "comment", x["id"], what, (x.get("user") or {}).get("login"), x.get("body") or "", x.get("path"), x.get("created_at"), x.get("html_url"), None)
                if reply and not note and reply.next and reply.left <= SPARE:
                    note = reply.limit_note()
                if note:
                    yield (kind, number, "note", *[None] * 7, note)
                    return
                if reply.status >= 400 or not reply.next:  # gone, closed to us, or whole
                    break
                link, query = reply.next, None
        yield (kind, number, "done", *[None] * 8)


def comments(targets: DataFrame, base: str, repo: str, most: int = COMMENT_REQUESTS, token: str | None = None) -> DataFrame:
    """Discussion threads of targets (tier, parent_type, number, review), least tier first and newest number first, in one run of at most `most`
    requests: rows of `what` comment, done (a target whose threads are whole; a thread has THREAD_PAGES pages at most) and note (why the run
    stopped; the target in hand and all after it aren't done). The server's allowance is for all machines together, so one task asks;
    it holds a page at a time. A lost task asks again, and upserts by comment_id take its rows as they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = (r for b in batches for r in zip(b["parent_type"], b["number"], b["review"], strict=True))
        part = []
        for row in _threads(Server(base, token), repo, asked, most):
            part.append(row)
            if len(part) == 1000:
                yield pd.DataFrame(part, columns=names, dtype=object)
                part = []
        yield pd.DataFrame(part, columns=names, dtype=object)

    names = [x.split()[0] for x in COMMENT.split(", ")]
    first = targets.orderBy("tier", F.col("number").desc(), "parent_type").limit(most).select("parent_type", "number", "review").coalesce(1)  # a request each at least
    return first.mapInPandas(run, COMMENT)
