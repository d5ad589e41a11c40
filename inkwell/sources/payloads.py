"""Payloads fetched over HTTP: a Spark data source, and the same for a table of references.

    spark.dataSource.register(PayloadSource)
    spark.read.format("payload").option("url", "https://host/{constituent}/{reference}")
         .option("path", "references.parquet").option("constituents", "biblio,claims").load()

    fetch_all(references, "https://host/{constituent}/{reference}", ["biblio", "claims"])

The data source reads its references from a Parquet file or folder (column `reference`), one
slice in each task; `fetch_all` takes any DataFrame and fetches where its rows lie. Answers
become rows (reference, constituent, status, payload, outcome), so a missing or
refused answer is a value and no job fails. Overload and server errors are tried again with
growing pauses, or the pause the server asks for.
"""

from __future__ import annotations

import base64
import json
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyarrow import dataset
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Outcomes by status.
OUTCOMES = {200: "ok", 204: "no_result", 400: "invalid_request", 401: "auth", 403: "auth", 404: "no_result", 406: "not_acceptable", 429: "rate_limit"}
RETRIED = (429, 500, 502, 503)
ATTEMPTS, PAUSE = 3, 0.5


def outcome(status: int | None, body: str = "") -> str:
    if status == 403 and "fair use" in body.lower():
        return "rate_limit"
    return OUTCOMES.get(status or 0, "unavailable")


def fetched_bytes(url: str, timeout: float, attempts: int = ATTEMPTS, pause: float = PAUSE, headers: dict[str, str] | None = None) -> tuple[int | None, bytes]:
    """(status, body); status is null where no answer came."""
    status, body = None, b""
    for k in range(attempts):
        wait = pause * 2**k
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=timeout) as answer:  # noqa: S310
                return answer.status, answer.read()
        except urllib.error.HTTPError as e:
            status, body = e.code, e.read()
            asked = e.headers.get("Retry-After", "")
            wait = float(asked) if asked.isdigit() else wait
            if status not in RETRIED:
                return status, body
        except (urllib.error.URLError, OSError):
            status, body = None, b""
        if k + 1 < attempts:
            time.sleep(wait)
    return status, body


def fetched(url: str, timeout: float, attempts: int = ATTEMPTS, pause: float = PAUSE, headers: dict[str, str] | None = None) -> tuple[int | None, str]:
    status, body = fetched_bytes(url, timeout, attempts, pause, headers)
    return status, body.decode("utf-8", "replace")


@dataclass
class Token:
    """A bearer token, fetched once in each worker and again shortly before it runs out."""

    url: str
    user: str
    secret: str
    timeout: float = 20.0
    _value: str = field(default="", repr=False)
    _until: float = 0.0

    def __post_init__(self) -> None:
        self._lock = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_lock": None, "_value": "", "_until": 0.0}

    def get(self) -> str:
        if time.monotonic() < self._until:
            return self._value
        self._lock = self._lock or threading.Lock()
        with self._lock:
            if time.monotonic() >= self._until:  # nobody fetched it while this one waited
                basic = base64.b64encode(f"{self.user}:{self.secret}".encode()).decode()
                asked = urllib.request.Request(self.url, data=b"grant_type=client_credentials", headers={"Authorization": f"Basic {basic}", "Content-Type": "application/x-www-form-urlencoded"})  # noqa: S310
                with urllib.request.urlopen(asked, timeout=self.timeout) as answer:  # noqa: S310
                    said = json.loads(answer.read())
                self._value = said["access_token"]
                self._until = time.monotonic() + max(float(said.get("expires_in", 60)) - 30, 30)
            return self._value


def headers_of(token: Token | None = None, basic: tuple[str, str] | None = None, accept: str | None = None) -> dict[str, str]:
    out = {"Accept": accept} if accept else {}
    if token is not None:
        out["Authorization"] = f"Bearer {token.get()}"
    elif basic is not None:
        out["Authorization"] = "Basic " + base64.b64encode(":".join(basic).encode()).decode()
    return out


ANSWER = "reference string, constituent string, status int, payload string, outcome string"


def fetch_all(references: DataFrame, url: str, constituents: list[str], token: Token | None = None, basic: tuple[str, str] | None = None, timeout: float = 20.0, pause: float = PAUSE) -> DataFrame:
    """ANSWER for each reference (column `reference`) and constituent, fetched in the partition
    that holds the reference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for reference in batch.column(0).to_pylist():
                for part in constituents if reference else []:
                    address = url.replace("{reference}", urllib.parse.quote(reference, safe="")).replace("{constituent}", part)
                    status, body = fetched(address, timeout, pause=pause, headers=headers_of(token, basic))
                    rows.append((reference, part, status, body if status == 200 else None, outcome(status, body)))
            types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["reference", "constituent", "status", "payload", "outcome"])

    return references.select("reference").mapInArrow(run, ANSWER)


def pages(documents: DataFrame, url: str, key: str = "reference", count: str = "pages", most_pages: int = 300, most_bytes: int = 100 * 1024**2, at_once: int = 3, token: Token | None = None, timeout: float = 20.0, pause: float = PAUSE) -> DataFrame:
    """`documents` has key and the number of their pages. key, page, content, error: every page
    of a document in order, `at_once` fetched at a time. A document with more than `most_pages`
    pages, more bytes than `most_bytes` or a page that can't be had gives one row with the error
    and none of its pages: later pages aren't fetched once it has failed."""

    def whole(reference: str, n: int) -> list[tuple]:
        if not n or n < 0:
            return []
        if n > most_pages:
            return [(reference, None, None, "too_many_pages")]
        got, size = [], 0
        with ThreadPoolExecutor(at_once) as pool:
            for first in range(1, n + 1, at_once):
                here = range(first, min(n, first + at_once - 1) + 1)
                address = [url.replace("{reference}", urllib.parse.quote(reference, safe="")).replace("{page}", str(k)) for k in here]
                for k, (status, body) in zip(here, pool.map(lambda a: fetched_bytes(a, timeout, pause=pause, headers=headers_of(token)), address)):
                    if status != 200:
                        return [(reference, k, None, outcome(status))]
                    size += len(body)
                    if size > most_bytes:
                        return [(reference, k, None, "too_large")]
                    got.append((reference, k, body, None))
        return got

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for reference, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = whole(reference, n) if reference else []
                types = [pa.string(), pa.int32(), pa.binary(), pa.string()]
                cols = list(zip(*rows)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[key, "page", "content", "error"])

    return documents.select(F.col(key).cast("string").alias(key), F.col(count).cast("int").alias(count)).mapInArrow(run, f"`{key}` string, page int, content binary, error string")


# How a file of each kind begins.
SIGNATURES = {"zip": b"PK", "pdf": b"%PDF-"}


def downloads(links: DataFrame, kind: str, hosts: list[str], most_bytes: int = 100 * 1024**2, timeout: float = 20.0, redirects: int = 6, secure: bool = True) -> DataFrame:
    """`links` has url. url, content, error: a file of the kind (zip, pdf) from one of `hosts`.
    Redirects are followed by hand, each new address checked like the first; a file that is too
    large is dropped while it arrives, one that begins otherwise than its kind is refused."""

    def allowed(address: str) -> bool:
        parts = urllib.parse.urlsplit(address)
        return (parts.scheme == "https" or not secure) and parts.hostname in hosts and not parts.username

    def one(address: str | None) -> tuple[bytes | None, str | None]:
        for _ in range(redirects + 1):
            if not address or not allowed(address):
                return None, "not_allowed"
            try:
                with _straight().open(urllib.request.Request(address), timeout=timeout) as answer:  # noqa: S310
                    if answer.headers.get("Content-Length", "").isdigit() and int(answer.headers["Content-Length"]) > most_bytes:
                        return None, "too_large"
                    data = answer.read(most_bytes + 1)
                if len(data) > most_bytes:
                    return None, "too_large"
                return (data, None) if data.startswith(SIGNATURES[kind]) else (None, "invalid_content")
            except urllib.error.HTTPError as e:
                if e.code not in (301, 302, 303, 307, 308) or not e.headers.get("Location"):
                    return None, outcome(e.code)
                address = urllib.parse.urljoin(address, e.headers["Location"])
            except (urllib.error.URLError, OSError):
                return None, "unavailable"
        return None, "too_many_redirects"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for address in batch.column(0).to_pylist():
                content, error = one(address)
                yield pa.RecordBatch.from_arrays([pa.array([address], pa.string()), pa.array([content], pa.binary()), pa.array([error], pa.string())], names=["url", "content", "error"])

    return links.select("url").mapInArrow(run, "url string, content binary, error string")


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs):  # noqa: ANN002, ANN003
        return None


@cache
def _straight() -> urllib.request.OpenerDirector:
    return urllib.request.build_opener(_NoRedirect)


class _Slice(InputPartition):
    def __init__(self, nth: int) -> None:
        self.nth = nth


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.url, self.constituents = options["url"], [c for c in options.get("constituents", options.get("constituent", "biblio")).split(",") if c]
        self.path, self.inline = options.get("path", ""), [r for r in options.get("references", "").split(",") if r]
        self.slices = int(options.get("slices", "8"))
        self.timeout, self.pause = float(options.get("timeout", "20")), float(options.get("pause", str(PAUSE)))
        self.token = Token(options["token_url"], options.get("user", ""), options.get("secret", "")) if options.get("token_url") else None

    def partitions(self) -> list[InputPartition]:
        return [_Slice(k) for k in range(max(1, self.slices if self.path else min(self.slices, len(self.inline))))]

    def _references(self, nth: int) -> Iterator[str]:
        """Every slice reads the file itself and keeps the references whose turn it is."""
        if not self.path:
            yield from self.inline[nth :: self.slices]
            return
        at = 0
        for batch in dataset.dataset(self.path.removeprefix("file://")).to_batches(columns=["reference"]):
            for reference in batch.column(0).to_pylist():
                if reference and at % self.slices == nth:
                    yield reference
                at += 1

    def read(self, partition: _Slice) -> Iterator[tuple]:
        for reference in self._references(partition.nth):
            for part in self.constituents:
                url = self.url.replace("{reference}", urllib.parse.quote(reference, safe="")).replace("{constituent}", part)
                status, body = fetched(url, self.timeout, pause=self.pause, headers=headers_of(self.token))
                yield reference, part, status, body if status == 200 else None, outcome(status, body)


class PayloadSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "payload"

    def schema(self) -> str:
        return ANSWER

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
