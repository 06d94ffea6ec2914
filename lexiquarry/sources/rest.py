"""A paginated REST listing as a Spark data source, in batches and as a stream: one partition for each day; filters on dates and types become requests."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from lexiquarry.operators.ingest import LEAST_CHARS

LISTING = "document_number string, title string, type string, publication_date string"


def http(url: str, timeout: float = 60) -> tuple[int, bytes]:
    try:
        with urllib.request.urlopen(url, timeout=timeout) as answer:
            return answer.status, answer.read()
    except urllib.error.HTTPError as e:
        return e.code, b""


def get(url: str, transport: Callable = http, tries: int = 4, sleep: Callable = time.sleep) -> bytes | None:
    """The body, None if there is no such page; too many requests, server and network errors are tried again after a growing pause."""
    for attempt in range(tries):
        try:
            status, body = transport(url)
        except OSError:
            status, body = 599, b""
        if status == 404:
            return None
        if status == 429 or status >= 500:
            sleep(2**attempt)
            continue
        if status >= 400:
            raise RuntimeError(f"{url}: HTTP {status}")
        return body
    raise RuntimeError(f"{url}: no answer in {tries} attempts")


class Day(InputPartition):
    def __init__(self, value: str):
        super().__init__(value)


def weekdays(first: date, last: date) -> list[date]:
    """Mondays to Fridays from ``first`` to ``last``."""
    return [d for d in (first + timedelta(days=i) for i in range((last - first).days + 1)) if d.weekday() < 5]


def _types(options: dict) -> list[str]:
    return [t for t in options.get("types", "").split(",") if t]


class ListingReader(DataSourceReader):
    """Days and types narrow by the filters of the query; what a request answers exactly is not filtered again."""

    def __init__(self, options: dict):
        self.options = options
        self.first, self.last = date.fromisoformat(options["start"]), date.fromisoformat(options["end"])
        if self.first > self.last:
            raise ValueError("start is after end")
        self.days: set[date] | None = None
        self.types = _types(options)
        self.none = False

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self._push(f):
                yield f

    def _push(self, f: Filter) -> bool:
        values = list(f.value) if isinstance(f, In) else [getattr(f, "value", None)]
        if getattr(f, "attribute", None) == ("type",) and isinstance(f, (EqualTo, In)):
            asked = [v for v in values if v is not None]
            self.types = [t for t in asked if t in self.types] if self.types else asked
            self.none = self.none or not self.types
            return True
        if getattr(f, "attribute", None) == ("publication_date",) and all(isinstance(v, str) for v in values):
            try:
                days = [date.fromisoformat(v) for v in values]
            except ValueError:
                return False
            if any(d.isoformat() != v for d, v in zip(days, values)):
                return False
            if isinstance(f, (EqualTo, In)):
                self.days = set(days) if self.days is None else self.days & set(days)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, days[0] + timedelta(days=isinstance(f, GreaterThan)))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.last = min(self.last, days[0] - timedelta(days=isinstance(f, LessThan)))
            else:
                return False
        return False  # the source's dates are compared once more, since they are text

    def partitions(self) -> list[Day]:
        days = [] if self.none else [d for d in weekdays(self.first, self.last) if self.days is None or d in self.days]
        return [Day(d.isoformat()) for d in days] or [Day("")]

    def read(self, partition: Day) -> Iterator[tuple]:
        if partition.value:
            yield from list_day(self.options["url"], partition.value, self.types)


#: Days before the cursor that a stream looks at again.
BACK = 7


class ListingStreamReader(DataSourceStreamReader):
    """The offset is the day after the last one listed. A batch lists the days up to today, and ``back`` days before them again."""

    def __init__(self, options: dict):
        self.options = options
        self.back = int(options.get("back", BACK))

    def _today(self) -> date:
        return date.fromisoformat(self.options["today"]) if self.options.get("today") else date.today()

    def initialOffset(self) -> dict:
        return {"day": self.options["start"]}

    def latestOffset(self) -> dict:
        return {"day": max(date.fromisoformat(self.options["start"]), self._today() + timedelta(days=1)).isoformat()}

    def partitions(self, start: dict, end: dict) -> list[Day]:
        first, last = date.fromisoformat(start["day"]), date.fromisoformat(end["day"]) - timedelta(days=1)
        first = max(date.fromisoformat(self.options["start"]), first - timedelta(days=self.back))
        return [Day(d.isoformat()) for d in weekdays(first, last)] or [Day("")]

    def read(self, partition: Day) -> Iterator[tuple]:
        if partition.value:
            yield from list_day(self.options["url"], partition.value, _types(self.options))

    def commit(self, end: dict) -> None:
        """Spark keeps the offset in the stream's checkpoint; there is nothing to free at the source."""


def list_day(base: str, day: str, types: list[str], transport: Callable = http, sleep: Callable = time.sleep) -> Iterator[tuple]:
    """A day's documents, page after page."""
    asked = [("conditions[publication_date][is]", day), ("per_page", "1000"), *[("conditions[type][]", t) for t in types]]
    url: str | None = f"{base}?{urllib.parse.urlencode(asked)}"
    while url:
        body = get(url, transport, sleep=sleep)
        if body is None:
            return
        page = json.loads(body)
        for row in page.get("results") or []:
            yield row.get("document_number"), row.get("title"), row.get("type"), row.get("publication_date")
        url = page.get("next_page_url")


class Listing(DataSource):
    """``spark.read.format("rest_listing")`` with options url, start, end, types (comma-separated)."""

    @classmethod
    def name(cls) -> str:
        return "rest_listing"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options)


def listing(spark: SparkSession, url: str, start: str, end: str, types: tuple[str, ...] = ()) -> DataFrame:
    """The listing as a table; Spark hands its filters to such sources only where that is switched on, which this does."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Listing)
    return spark.read.format("rest_listing").options(url=url, start=start, end=end, types=",".join(types)).load()


class ListingStream(DataSource):
    """``spark.readStream.format("rest_stream")`` with options url, start, and optionally types, back (days) and today."""

    @classmethod
    def name(cls) -> str:
        return "rest_stream"

    def schema(self) -> str:
        return LISTING

    def streamReader(self, schema) -> ListingStreamReader:
        return ListingStreamReader(self.options)


def documents(fetched: DataFrame) -> DataFrame:
    """Document rows of :func:`fetch`'s details and raw pages."""
    from lexiquarry import schemas
    from lexiquarry.functions.text import page_text
    from lexiquarry.operators.ingest import records

    parsed = fetched.select(F.from_json("detail", schemas.DETAIL).alias("d"), page_text("raw").alias("text"))
    return records(parsed.select("d.*", "text"))


def _detail(base: str, number: str) -> str:
    return f"{base}/{urllib.parse.quote(number, safe='')}.json"


def fetch(listing: DataFrame, base: str, transport: Callable = http, key: str = "document_number") -> DataFrame:
    """``(document_number, detail, raw)``: a document's details and raw page; those without a text of some length are left out. One task for each partition of ``listing``."""

    def run(source):
        for pdf in source:
            rows = []
            for number in pdf[key].dropna():
                detail = get(_detail(base, number), transport)
                url = json.loads(detail).get("raw_text_url") if detail else None
                raw = get(url, transport) if url else None
                text = raw.decode("utf-8", "replace") if raw else ""
                if len(text) >= LEAST_CHARS:
                    rows.append((number, detail.decode(), text))
            yield pd.DataFrame(rows, columns=["document_number", "detail", "raw"])

    return listing.select(key).mapInPandas(run, "document_number string, detail string, raw string")


def probe(base: str, day: str, transport: Callable = http) -> dict | None:
    """The details of one document of ``day``, which show the source's field names; None if the day has none."""
    for number, *_ in list_day(base, day, [], transport):
        body = get(_detail(base, number), transport)
        return json.loads(body) if body else None
    return None


def missing_fields(sample: DataFrame, kept: list[str]) -> list[str]:
    """Fields that are expected of the source and that it does not have."""
    return sorted(set(kept) - set(sample.columns))
