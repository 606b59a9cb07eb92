"""A Python data source for paged web interfaces, with an offline stand-in that reads canned answers."""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BATCH = 50
#: Longest chain of redirects that is followed.
REDIRECTS = 3


class Titles(InputPartition):
    def __init__(self, titles: list[str]) -> None:
        super().__init__(titles)
        self.titles = titles


class PageReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.titles = json.loads(options["titles"])
        self.path = options["answers"]

    def partitions(self) -> list[Titles]:
        return [Titles(self.titles[i : i + BATCH]) for i in range(0, len(self.titles), BATCH)] or [Titles([])]

    def read(self, partition: Titles) -> Iterator[tuple]:
        with open(self.path, encoding="utf-8") as file:
            pages = {p["title"]: p for p in map(json.loads, file)}
        for asked in partition.titles:
            title, hops = asked, 0
            while title in pages and pages[title].get("redirect") and hops < REDIRECTS:
                title, hops = pages[title]["redirect"], hops + 1
            page = pages.get(title)
            missing = page is None or bool(page.get("redirect"))
            yield (asked, None, None, None, True) if missing else (asked, title, page.get("page_id"), page.get("wikitext"), False)


class PageSource(DataSource):
    """Pages by title in batches: options `titles`, a JSON list, and `answers`, a file of JSON lines (title, page_id, wikitext or redirect)."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "requested string, title string, page_id long, wikitext string, missing boolean"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)


class EntityReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.ids = list(dict.fromkeys(json.loads(options["ids"])))
        self.path = options["answers"]

    def partitions(self) -> list[Titles]:
        return [Titles(self.ids[i : i + BATCH]) for i in range(0, len(self.ids), BATCH)] or [Titles([])]

    def read(self, partition: Titles) -> Iterator[tuple]:
        with open(self.path, encoding="utf-8") as file:
            known = {e["id"]: e for e in map(json.loads, file)}
        for asked in partition.titles:
            entity = known.get(asked)
            if entity is None or "missing" in entity:
                continue
            texts = lambda part: {k: v["value"] for k, v in (entity.get(part) or {}).items()}
            aliases = {k: [a["value"] for a in v] for k, v in (entity.get("aliases") or {}).items()}
            claims = {}
            for prop, statements in (entity.get("claims") or {}).items():
                claims[prop] = []
                for s in statements:
                    snak = s.get("mainsnak") or {}
                    value = (snak.get("datavalue") or {}).get("value")
                    value = value if isinstance(value, dict) else {}
                    claims[prop].append((s.get("rank"), snak.get("snaktype"), value.get("time"), value.get("precision"), value.get("id")))
            yield asked, texts("labels"), texts("descriptions"), aliases, claims


class EntitySource(DataSource):
    """Entities by number in batches: options `ids`, a JSON list, and `answers`, a file of JSON lines as the interface gives them; missing ones are left out."""

    @classmethod
    def name(cls) -> str:
        return "wikidata_entities"

    def schema(self) -> str:
        return "id string, labels map<string,string>, descriptions map<string,string>, aliases map<string,array<string>>, claims map<string,array<struct<rank:string,snaktype:string,time:string,precision:int,target:string>>>"

    def reader(self, schema) -> EntityReader:
        return EntityReader(self.options)


class DiskCache:
    """Answers by address and sorted parameters, compressed, good for `days`; an unreadable one counts as missing."""

    def __init__(self, folder: str, days: float = 7.0, clock: Callable[[], float] = time.time) -> None:
        self.folder, self.seconds, self.clock = folder, days * 86400, clock
        os.makedirs(folder, exist_ok=True)

    def _path(self, api: str, params: dict) -> str:
        key = hashlib.sha1((api + json.dumps(params, sort_keys=True, ensure_ascii=False)).encode()).hexdigest()
        return os.path.join(self.folder, key + ".json.gz")

    def get(self, api: str, params: dict, fetch: Callable[[], dict]) -> dict:
        path = self._path(api, params)
        try:
            if self.clock() - os.path.getmtime(path) < self.seconds:
                with gzip.open(path, "rt", encoding="utf-8") as file:
                    return json.load(file)
        except (OSError, ValueError, EOFError):
            pass
        answer = fetch()
        with gzip.open(path + ".part", "wt", encoding="utf-8") as file:
            json.dump(answer, file, ensure_ascii=False)
        os.replace(path + ".part", path)
        return answer
