"""Paged web sources as a Spark data source.

A transport is a callable (request: dict) -> dict, a lambda too: it travels by value; tests and offline runs give a
fake one. Each seed is a partition, so a lost task repeats one seed only. Secrets are
options of the reader, never columns. Registered as the format ``paged``.
"""

from __future__ import annotations

import base64
import json
import os
import pickle
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

Transport = Callable[[dict], dict]


class Stop(Exception):
    """Raised by a transport for an answer that ends a seed (400, 401): what was read so far stays."""


class Retry(Exception):
    """Raised by a transport for an answer worth another try (429, 5xx, lag)."""


def polite(transport: Transport, delay: float, headers: dict[str, str] | None = None, sleep=time.sleep) -> Transport:
    """A transport that sends its headers (User-Agent and the like) with each request and rests for ``delay`` seconds after it."""

    def call(request: dict) -> dict:
        answer = transport({**request, "headers": {**(headers or {}), **request.get("headers", {})}})
        sleep(delay)
        return answer

    return call


def secret(name: str, path: str | None = None) -> str:
    """A key from the environment, else from a file of the driver's; neither: a ValueError. To be given to a transport, never to a plan."""
    found = os.environ.get(name, "")
    if not found and path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            found = f.read().strip()
    if not found:
        raise ValueError(f"no key: neither {name} nor {path}")
    return found


def wiki_request(kind: str) -> dict:
    """The query parts of a wiki's API: files of a category, its subcategories, or a full-text search."""
    parts = {
        "files": {"list": "categorymembers", "cmtype": "file"},
        "subcategories": {"list": "categorymembers", "cmtype": "subcat"},
        "search": {"list": "search", "srnamespace": 6},
    }
    return {"action": "query", "format": "json", "maxlag": 5, **parts[kind]}


def wiki_transport(post: Transport, kind: str) -> Transport:
    """A paged transport over a wiki's API. post(parameters) gives {"status", "json"}; lag, 429 and 5xx are tried again.

    The seed is the category or the search text; the continue token is the next position.
    """
    name = {"search": "srsearch"}.get(kind, "cmtitle")
    listed = "search" if kind == "search" else "categorymembers"

    def call(request: dict) -> dict:
        token = json.loads(request["token"]) if request.get("token") else {}
        answer = post({**wiki_request(kind), name: request["seed"], **token})
        body = answer.get("json") or {}
        if answer.get("status", 200) == 429 or answer.get("status", 200) >= 500 or body.get("error", {}).get("code") == "maxlag":
            raise Retry
        follow = body.get("continue")
        return {"rows": body.get("query", {}).get(listed, []), "next": json.dumps(follow) if follow else None}

    return call


def status_transport(get: Transport, retry: Sequence[int] = (403, 429), stop: Sequence[int] = (400, 401)) -> Transport:
    """A transport over plain answers {"status", "json"}: some are tried again, some end the seed, others without 200 give nothing."""

    def call(request: dict) -> dict:
        answer = get(request)
        status = answer.get("status", 200)
        if status in stop:
            raise Stop
        if status in retry or status >= 500:
            raise Retry
        return answer.get("json") or {} if status == 200 else {}

    return call


def department_objects(spark: SparkSession, get: Transport, departments: list[str], size: int = 1) -> DataFrame:
    """(department, object_id, body): the ids of each department, then each object's record; objects without one are left out.

    get({"department"}) gives {"ids": [...]}, get({"object"}) a record.
    """

    def ids(request: dict) -> dict:
        return {"rows": (get({"department": request["seed"]}) or {}).get("ids") or []}

    listed = read_paged(spark, ids, departments, Paging("token"))
    keys = listed.select(F.col("seed").alias("department"), F.col("body").alias("object_id")).distinct()
    found = lookup_in_batches(keys, "object_id", lambda q: {"rows": {k: get({"object": k}) for k in q["keys"]}}, size)
    return keys.join(found, "object_id").select("department", "object_id", "body")


def with_retries(transport: Transport, request: dict, tries: int = 6, wait: float = 1.0, most: float = 600.0, sleep=time.sleep) -> dict | None:
    """The answer, or None after ``tries`` failures; the wait doubles up to ``most`` seconds."""
    for attempt in range(tries):
        try:
            return transport(request)
        except Stop:
            return None
        except Retry:
            sleep(min(most, wait * 2**attempt))
    return None


@dataclass
class Paging:
    """How to go from page to page. kind: token, offset, page or cursor."""

    kind: str = "token"
    size: int = 50
    max_pages: int = 1_000_000
    extra: dict = field(default_factory=dict)

    def pages(self, fetch: Callable[[dict], dict | None], request: dict) -> Iterator[list]:
        position: object = {"offset": 0, "page": 1, "cursor": "*"}.get(self.kind)
        for _ in range(self.max_pages):
            asked = {**request, **self.extra, "size": self.size}
            if position is not None:
                asked[self.kind] = position
            answer = fetch(asked)
            rows = (answer or {}).get("rows") or []
            if not rows:
                return
            yield rows
            if self.kind == "offset":
                position += len(rows)
                if position >= answer.get("total", 0):
                    return
            elif self.kind == "page":
                position += 1
                if position > answer.get("page_count", self.max_pages):
                    return
            else:
                position = answer.get("next")
                if position is None:
                    return


class _Seed(InputPartition):
    def __init__(self, seed: str):
        self.seed = seed


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.seeds = json.loads(options["seeds"])
        self.paging = Paging(**json.loads(options.get("paging", "{}")))
        self.limit = int(options.get("limit", 0))
        self.transport = pickle.loads(base64.b64decode(options["transport"]))

    def partitions(self) -> list[_Seed]:
        return [_Seed(s) for s in self.seeds]

    def read(self, partition: _Seed) -> Iterator[tuple]:
        n = 0  # limit counts the rows of a seed
        for rows in self.paging.pages(lambda q: with_retries(self.transport, q), {"seed": partition.seed}):
            for row in rows:
                if self.limit and n >= self.limit:
                    return
                yield partition.seed, n, json.dumps(row, ensure_ascii=False)
                n += 1


class PagedSource(DataSource):
    """Options: seeds (JSON list), paging (JSON of Paging), limit (rows a seed), transport (base64 of a pickle)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "seed string, pos long, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_paged(spark: SparkSession, transport: Transport, seeds: list[str], paging: Paging | None = None, limit: int = 0) -> DataFrame:
    spark.dataSource.register(PagedSource)
    reader = spark.read.format("paged").option("seeds", json.dumps(seeds)).option("paging", json.dumps((paging or Paging()).__dict__))
    return reader.option("limit", limit).option("transport", base64.b64encode(cloudpickle.dumps(transport)).decode()).load()


def walk_categories(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(category, level): categories reached from roots in at most ``depth`` steps, each at its least level.

    edges: parent, child. A round joins only what the round before found new; depth bounds the rounds.
    """
    seen = roots.select("category", F.lit(0).alias("level")).distinct()
    frontier = seen
    for level in range(1, depth + 1):
        near = edges.join(frontier.select(F.col("category").alias("parent")), "parent").select(F.col("child").alias("category")).distinct()
        frontier = near.join(seen.select("category"), "category", "left_anti").withColumn("level", F.lit(level))
        seen = seen.unionByName(frontier)
    return seen


def receive(answer: dict | None, max_bytes: int, deadline: float, clock: Callable[[], float] = time.monotonic) -> tuple[bytes | None, str]:
    """(content, status) of {"status", "content"} or {"status", "chunks"}: chunks are added up until they are too many or too late."""
    began = clock()
    if answer is None:
        return None, "failed"
    if answer.get("status", 200) != 200:
        return None, f"http_{answer['status']}"
    if answer.get("content") is None and answer.get("chunks") is None:
        return None, "failed"
    body = bytearray()
    for chunk in answer.get("chunks") or [answer["content"]]:
        if clock() - began > deadline:
            return None, "too_late"
        if len(body) + len(chunk) > max_bytes:
            return None, "too_large"
        body += chunk
    return bytes(body), "ok"


def fetch_blobs(rows: DataFrame, url_col: str, transport: Transport, max_bytes: int = 60 << 20, deadline: float = 45.0, existing: DataFrame | None = None) -> DataFrame:
    """rows with content (binary or null) and status (ok, exists, too_large, too_late, http_<n>, failed).

    transport gives {"content": bytes} or {"chunks": an iterator of bytes}, which is left where the bytes or the seconds are too
    many. ``existing`` (url_col) names what is there already: not asked for again.
    """
    import pandas as pd

    if existing is not None:
        known = rows.join(existing.select(url_col).distinct(), url_col, "left_semi").select(*rows.columns)
        fetched = fetch_blobs(rows.join(existing.select(url_col).distinct(), url_col, "left_anti").select(*rows.columns), url_col, transport, max_bytes, deadline)
        return fetched.unionByName(known.withColumns({"content": F.lit(None).cast("binary"), "status": F.lit("exists")}))

    names = rows.columns

    def run(batches):
        for pdf in batches:
            found = []
            for url in pdf[url_col]:
                found.append(receive(with_retries(transport, {"url": url}, tries=5), max_bytes, deadline))
            yield pd.concat([pdf, pd.DataFrame(found, columns=["content", "status"], index=pdf.index)], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.select(*names).mapInPandas(run, f"{fields}, content binary, status string")


def status_counts(fetched: DataFrame) -> DataFrame:
    return fetched.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def store_blobs(fetched: DataFrame, name_col: str, path: str) -> DataFrame:
    """(name, status) of the fetched rows, written as a table of (name, content): a part is renamed into place when it is whole, as Spark's committers do."""
    fetched.where("status = 'ok'").select(F.col(name_col).alias("name"), "content").write.mode("append").parquet(path)
    return fetched.sparkSession.read.parquet(path).select("name").distinct()


def lookup_in_batches(keys: DataFrame, key: str, transport: Transport, size: int = 50) -> DataFrame:
    """(key, body): metadata of distinct keys, ``size`` a request; keys without metadata are left out."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            values = pdf[key].tolist()
            for i in range(0, len(values), size):
                answer = with_retries(transport, {"keys": values[i : i + size]}) or {}
                found = answer.get("rows") or {}
                yield pd.DataFrame([(k, json.dumps(v, ensure_ascii=False)) for k, v in found.items() if v], columns=[key, "body"])

    return keys.select(key).distinct().mapInPandas(run, f"{key} string, body string")


# --- pages as a stream ---------------------------------------------------------------------------------


class _RequestReader(SimpleDataSourceStreamReader):
    """Which pages to ask for next: the offset is the number of the next page. What it gives are requests, a few bytes each; tasks do the asking."""

    def __init__(self, options: dict):
        self.counts: dict[str, int] = json.loads(options["counts"])
        self.step = int(options.get("pages", 1))

    def initialOffset(self) -> dict:
        return {"page": 1}

    def _between(self, first: int, after: int) -> Iterator[tuple]:
        return iter([(seed, page) for page in range(first, after) for seed, n in self.counts.items() if page <= n])

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        after = max(start["page"], min(start["page"] + self.step, max(self.counts.values(), default=0) + 1))
        return self._between(start["page"], after), {"page": after}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._between(start["page"], end["page"])


class PageRequests(DataSource):
    """Options: counts (JSON: seed -> pages), pages (of each seed in a batch)."""

    @classmethod
    def name(cls) -> str:
        return "page_requests"

    def schema(self) -> str:
        return "seed string, page int"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _RequestReader(self.options)


def read_pages(requests: DataFrame, transport: Transport, size: int = 50) -> DataFrame:
    """(seed, page, pos, body) of requests (seed, page), asked for where they lie; a page without an answer has no rows.

    Works on a table and on a stream alike.
    """
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for seed, page in zip(pdf["seed"], pdf["page"], strict=True):
                rows = (with_retries(transport, {"seed": seed, "page": int(page), "size": size}) or {}).get("rows") or []
                yield pd.DataFrame([(seed, int(page), i, json.dumps(row, ensure_ascii=False)) for i, row in enumerate(rows)], columns=["seed", "page", "pos", "body"])

    return requests.mapInPandas(run, "seed string, page int, pos int, body string")


def page_counts(spark: SparkSession, transport: Transport, seeds: list[str], size: int = 50) -> dict[str, int]:
    """How many pages each seed has, by the page_count of its first; asked for by tasks, a number a seed comes back."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answers = [with_retries(transport, {"seed": s, "page": 1, "size": size}) or {} for s in pdf["seed"]]
            yield pd.DataFrame({"seed": pdf["seed"], "n": [int(a.get("page_count", 1 if a.get("rows") else 0)) for a in answers]})

    rows = spark.createDataFrame([(s,) for s in dict.fromkeys(seeds)], "seed string").mapInPandas(run, "seed string, n int")
    return {r["seed"]: r["n"] for r in rows.collect()}


def stream_pages(spark: SparkSession, transport: Transport, seeds: list[str], pages: int = 1, size: int = 50) -> DataFrame:
    """The pages of the seeds as a stream of (seed, page, pos, body), ``pages`` of each seed in a batch; after the last it stands still."""
    spark.dataSource.register(PageRequests)
    counts = page_counts(spark, transport, seeds, size)
    requests = spark.readStream.format("page_requests").option("counts", json.dumps(counts)).option("pages", pages).load()
    return read_pages(requests, transport, size)
