"""Paged threads over HTTP as a Python data source, with the opener injected so tests need no network."""

from __future__ import annotations

import json
import os
import re
import subprocess
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader

from sparkloom.schema import THREADS

RETRY_ON = frozenset((403, 429, 500, 502, 503, 504))


def token(command: tuple[str, ...] | None = None) -> str | None:
    """From the environment, else what ``command`` prints, where one is given and can be run."""
    if held := os.environ.get("SPARKLOOM_TOKEN") or os.environ.get("API_TOKEN"):
        return held
    if command:
        try:
            return subprocess.run(command, capture_output=True, text=True, timeout=20, check=True).stdout.strip() or None
        except (OSError, subprocess.SubprocessError):
            return None
    return None


def fetch(url: str, data: bytes | None = None, bearer: str | None = None, retries: int = 4, pause: float = 1.0, opener: Callable = urllib.request.urlopen) -> bytes:
    """The body at ``url``; on busy and server errors again after growing pauses."""
    headers = {"Accept": "application/json"} | ({"Authorization": f"Bearer {bearer}"} if bearer else {})
    for attempt in range(retries + 1):
        try:
            with opener(urllib.request.Request(url, data=data, headers=headers)) as reply:
                return reply.read()
        except urllib.error.HTTPError as e:
            if e.code not in RETRY_ON or attempt == retries:
                raise
        except urllib.error.URLError:
            if attempt == retries:
                raise
        time.sleep(pause * 2**attempt)
    raise RuntimeError("unreachable")


def head_commit(get: Callable[[], dict]) -> str:
    """The full hash of the newest commit, by which a corpus is pinned; ``get`` returns the server's answer with a ``sha``."""
    sha = str(get().get("sha", ""))
    if not re.fullmatch("[0-9a-f]{40}", sha):
        raise RuntimeError(f"the source names no commit but {sha!r}")
    return sha


def listed_pages(tree: dict, root: str, suffix: str = ".md") -> list[str]:
    """Paths below ``root`` of a repository's tree; a tree that was cut short is an error."""
    if tree.get("truncated"):
        raise RuntimeError("the source lists only a part of its files")
    top = root.rstrip("/") + "/"
    return sorted(x["path"].removeprefix(top) for x in tree.get("tree", ()) if x.get("type") == "blob" and x["path"].startswith(top) and x["path"].endswith(suffix))


def pages(get: Callable[[str | None], dict], most: int | None = None) -> Iterator[dict]:
    """Rows of a cursor-paged source until its last page, or ``most`` rows where that is given. A reply with errors is an error."""
    cursor, seen = None, 0
    while True:
        reply = get(cursor)
        if reply.get("errors"):
            raise RuntimeError(f"the source reports {reply['errors']}")
        for row in reply.get("rows", ()):
            if seen == most:
                return
            seen += 1
            yield row
        cursor = reply.get("next")
        if not cursor:
            return


class ThreadReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def read(self, partition) -> Iterator[tuple]:
        url, most = self.options["url"], self.options.get("most")

        def get(cursor: str | None) -> dict:
            body = json.dumps({"cursor": cursor}).encode()
            return json.loads(fetch(url, body, token()))

        for r in pages(get, int(most) if most else None):
            a = r.get("answer")
            answer = a and tuple(a.get(k) for k in ("body", "body_text", "url", "created_at", "upvotes", "author", "author_association", "is_maintainer"))
            yield (*(r.get(k) for k in ("number", "title", "body", "body_text", "created_at", "url", "answered")), answer)


class ThreadSource(DataSource):
    """``spark.dataSource.register(ThreadSource)``, then ``spark.read.format("threads").option("url", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "threads"

    def schema(self) -> str:
        return THREADS

    def reader(self, schema) -> DataSourceReader:
        return ThreadReader(self.options)
