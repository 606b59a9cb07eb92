"""The graph behind HTTP: browsing, retrieval and answers as JSON.

Every route is a bounded query; a service holds an opened store. Only the
standard library's server is used, so a route is a plain method that other
servers may call as well.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annales.config import DEFAULT, Config
from annales.functions.years import overlaps
from annales.operators import browse, graph
from annales.operators.periods import chain
from annales.plans import pipeline

#: Rows that a route returns at most, and signs of a text put in by a user.
MOST_ROWS, MOST_SIGNS = 500, 20_000


class NotFound(Exception):
    """No such thing."""


def _rows(df: DataFrame, limit: int = MOST_ROWS) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.limit(limit).collect()]


class Service:
    """Routes over a store (see plans.pipeline)."""

    def __init__(self, spark: SparkSession, store: pipeline.Store, config: Config = DEFAULT) -> None:
        self.spark, self.store, self.config = spark, store, config
        self.degree = (store.degree if store.degree is not None else graph.degrees(store.edges)).cache()

    def health(self) -> dict:
        return {"status": "ok", "spark": self.spark.version, "periods": self.store.periods.count()}

    def stats(self) -> dict:
        counts = graph.label_counts(Chunk=self.store.chunks.select("id"), Entity=self.store.entities.select("id"), Period=self.store.periods.select("id"), Relation=self.store.edges.select("edge_id"))
        return {"labels": _rows(counts), "periods": _rows(graph.period_shares(self.store.in_period, self.store.periods))}

    def periods(self) -> list[dict]:
        counted = self.store.in_period.groupBy(F.col("period_id").alias("id")).agg(F.count_distinct("id").alias("n"))
        return _rows(self.store.periods.join(counted, "id", "left").withColumn("n", F.coalesce("n", F.lit(0))).orderBy("position"))

    def period(self, period_id: str) -> dict:
        found = _rows(self.store.periods.where(F.col("id") == period_id), 1)
        if not found:
            raise NotFound(period_id)
        links = chain(self.store.periods).where((F.col("id") == period_id) | (F.col("next_id") == period_id)).collect()
        return found[0] | {"next": next((r["next_id"] for r in links if r["id"] == period_id), None), "prev": next((r["id"] for r in links if r["next_id"] == period_id), None), "events": _rows(browse.event_timeline(self.store.entities, self.store.edges, self.store.in_period, period_id), 60)}

    def period_items(self, period_id: str, limit: int = 60) -> list[dict]:
        rows = browse.period_items(self.store.entities, self.store.in_period.where(F.col("period_id") == period_id), min(limit, MOST_ROWS))
        return _rows(rows.orderBy("rank"))

    def entity(self, entity_id: str) -> dict:
        found = _rows(self.store.entities.where(F.col("id") == entity_id), 1)
        if not found:
            raise NotFound(entity_id)
        ids = self.spark.createDataFrame([(entity_id,)], "id string")
        return found[0] | {"neighbours": _rows(browse.neighbours(self.store.edges, self.store.entities, ids), 1)[0]["neighbours"], "relations": _rows(browse.by_relation(self.store.edges, self.store.entities, ids))}

    def entity_passages(self, entity_id: str, limit: int = 6) -> list[dict]:
        """Chunks of the article about an entity, which bears its name."""
        named = self.store.entities.where(F.col("id") == entity_id).select("name").limit(1)
        rows = self.store.chunks.join(F.broadcast(named), F.col("page_title") == F.col("name")).orderBy("chunk_index", "id")
        return _rows(rows.select("id", "page_title", "section_path", "text"), min(limit, MOST_ROWS))

    def entities(self, q: str | None = None, type: str | None = None, period: str | None = None, limit: int = 60, skip: int = 0) -> list[dict]:
        rows = browse.entities(self.store.entities, self.degree, self.store.in_period, q, type, period, min(int(limit), MOST_ROWS), int(skip))
        return _rows(rows.select("id", "name", "type", "start_year", "end_year", "degree"))

    def _asked(self, question: str) -> DataFrame:
        return self.spark.createDataFrame([("q", question)], "query_id string, query string")

    def _during(self, low: int | None, high: int | None) -> pipeline.Store:
        """The store with chunks of the given years; what has no years stays."""
        if low is None or high is None:
            return self.store
        kept = self.store.chunks.where(F.col("min_year").isNull() | overlaps(F.col("min_year"), F.col("max_year"), F.lit(int(low)), F.lit(int(high))))
        vectors = self.store.chunk_vectors
        return pipeline.Store(**{**self.store.__dict__, "chunks": kept, "chunk_vectors": None if vectors is None else vectors.join(kept.select("id"), "id", "left_semi")})

    def retrieve(self, question: str, low: int | None = None, high: int | None = None, mode: str = "graph") -> dict:
        found = pipeline.retrieve(self._asked(question), self._during(low, high), self.config, mode)
        return {"plan": _rows(found.plans, 1), "chunks": _rows(found.chunks.orderBy("rank")), "triplets": _rows(found.triplets.orderBy("rank")), "citations": _rows(found.citations.orderBy("n")), "context": _rows(found.context, 1)}

    def chat(self, question: str, low: int | None = None, high: int | None = None, mode: str = "graph") -> Iterator[tuple[str, Any]]:
        """Events plan, token and done; the answer comes word by word."""
        plan = _rows(pipeline.plan_rules(self._asked(question), self.store.periods, self.config, self.store.eras), 1)[0]
        yield "plan", plan
        made = _rows(pipeline.answer(self._asked(question), self._during(low, high), self.config, mode), 1)[0]
        for word in re.findall(r"\S+\s*", made["answer"] or ""):
            yield "token", word
        yield "done", {"answer": made["answer"], "context": made["context"]}

    def document_ask(self, question: str, text: str) -> dict:
        docs = self.spark.createDataFrame([(1, text[:MOST_SIGNS])], "doc_id long, text string")
        return _rows(pipeline.ask_documents(self._asked(question), docs, config=self.config), 1)[0]


#: (method, pattern of the path, method of Service); named groups are arguments.
ROUTES = (
    ("GET", r"/health", "health"), ("GET", r"/stats", "stats"), ("GET", r"/periods", "periods"), ("GET", r"/periods/(?P<period_id>[^/]+)/items", "period_items"), ("GET", r"/periods/(?P<period_id>[^/]+)", "period"),
    ("GET", r"/entity/(?P<entity_id>[^/]+)/passages", "entity_passages"), ("GET", r"/entity/(?P<entity_id>[^/]+)", "entity"), ("GET", r"/entities", "entities"), ("POST", r"/retrieve", "retrieve"), ("POST", r"/chat", "chat"), ("POST", r"/document/ask", "document_ask"),
)


def route(service: Service, method: str, path: str, body: dict | None = None) -> Any:
    """What a request asks for; NotFound where no route or thing answers, ValueError for arguments that don't fit."""
    parts = urlsplit(path)
    for verb, pattern, name in ROUTES:
        if verb == method and (m := re.fullmatch(pattern, parts.path.rstrip("/"))):
            asked = {k: v[0] for k, v in parse_qs(parts.query).items()} | {k: unquote(v) for k, v in m.groupdict().items()} | (body or {})
            call: Callable = getattr(service, name)
            known = call.__func__.__code__.co_varnames[1 : call.__func__.__code__.co_argcount]
            if set(asked) - set(known):
                raise ValueError(f"unknown arguments: {sorted(set(asked) - set(known))}")
            try:
                return call(**{k: int(v) if k in ("limit", "skip", "low", "high") and v is not None else v for k, v in asked.items()})
            except TypeError as e:
                raise ValueError(str(e)) from e
    raise NotFound(parts.path)


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _answer(self, method: str) -> None:
            try:
                size = int(self.headers.get("Content-Length") or 0)
                result, status = route(service, method, self.path, json.loads(self.rfile.read(size)) if size else None), 200
            except NotFound as e:
                result, status = {"detail": f"not found: {e}"}, 404
            except ValueError as e:
                result, status = {"detail": str(e)}, 422
            stream = isinstance(result, Iterator)
            self.send_response(status)
            self.send_header("Content-Type", "text/event-stream" if stream else "application/json; charset=utf-8")
            self.end_headers()
            for event, data in result if stream else [(None, result)]:
                text = json.dumps(data, ensure_ascii=False, default=str)
                self.wfile.write((f"event: {event}\ndata: {text}\n\n" if stream else text).encode())

        def do_GET(self) -> None:
            self._answer("GET")

        def do_POST(self) -> None:
            self._answer("POST")

        def log_message(self, *args: Any) -> None:
            """Quiet."""

    return Handler


def serve(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server bound to host and port; call serve_forever on it."""
    return ThreadingHTTPServer((host, port), handler(service))
