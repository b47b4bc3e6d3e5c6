"""Sources behind a paged interface, as Python data sources; the fetching callable is handed in.

``keyset`` walks pages by a continuation token and reads each page of keys once. ``timeline`` is a stream whose
offset is the time of the last row seen: rows at the edge of a page may come twice after a failure, so its reader is meant to be
followed by dropDuplicatesWithinWatermark.
"""

from __future__ import annotations

import base64
import time
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader


def packed(fn: Callable) -> str:
    """A callable as an option's text."""
    return base64.b64encode(cloudpickle.dumps(fn)).decode()


def _unpacked(text: str) -> Callable:
    return cloudpickle.loads(base64.b64decode(text))


class _Pages(DataSourceReader):
    """fetch(token) -> (rows, next token or None). Page tokens depend on each other, so the walk is one partition; what is expensive, reading the pages' contents, is a later mapInPandas over all executors."""

    def __init__(self, options):
        self.fetch, self.retries, self.wait = _unpacked(options["fetch"]), int(options.get("retries", "3")), float(options.get("wait", "1"))

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition) -> Iterator[tuple]:
        token = None
        while True:
            for left in range(self.retries, -1, -1):
                try:
                    rows, token = self.fetch(token)
                    break
                except OSError:
                    if not left:
                        raise
                    time.sleep(self.wait)
            yield from (tuple(r) for r in rows)
            if token is None:
                return


class KeysetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyset"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema) -> DataSourceReader:
        return _Pages(self.options)


class _Timeline(SimpleDataSourceStreamReader):
    """fetch(after) -> rows in time order, the time as epoch seconds in the column ``at``."""

    def __init__(self, options):
        self.fetch, self.at, self.start = _unpacked(options["fetch"]), int(options.get("at", "0")), int(options.get("start", "0"))

    def initialOffset(self) -> dict:
        return {"after": self.start}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = [tuple(r) for r in self.fetch(start["after"])]
        return iter(rows), {"after": max([start["after"], *(r[self.at] for r in rows)])}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([r for r in map(tuple, self.fetch(start["after"])) if r[self.at] <= end["after"]])

    def commit(self, end: dict) -> None:
        pass


class TimelineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "timeline"

    def schema(self) -> str:
        return self.options["schema"]

    def simpleStreamReader(self, schema):
        return _Timeline(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(KeysetSource)
    spark.dataSource.register(TimelineSource)


def fetched(df: DataFrame, key: str, fetch: Callable[[object], dict], schema: T.StructType) -> DataFrame:
    """(schema): what fetch gives for each key, over all executors; None gives no row."""

    def run(parts):
        import pandas as pd

        for pdf in parts:
            rows = [r for r in (fetch(k) for k in pdf[key]) if r is not None]
            yield pd.DataFrame(rows, columns=schema.names)

    return df.select(key).mapInPandas(run, schema)


def archive_posts(index: DataFrame, url: str = "original", ts: str = "timestamp", since: int | None = None, until: int | None = None) -> DataFrame:
    """(post_id, slug, timestamp, original): the earliest snapshot of each post in an archive's index, variants of its page left out."""
    year = F.substring(ts, 1, 4).cast("int")
    rows = index.withColumns({"post_id": F.regexp_extract(url, r"/post/(\d+)(?:/([^/?#]*))?", 1), "slug": F.regexp_extract(url, r"/post/(\d+)(?:/([^/?#]*))?", 2)})
    rows = rows.where("post_id <> ''").where(~F.col(url).rlike(r"/embed|/amp|\?route"))
    rows = rows.where(F.lit(True) if since is None else year >= since).where(F.lit(True) if until is None else year <= until)
    best = F.min_by(F.struct("slug", F.col(ts).alias("timestamp"), F.col(url).alias("original")), F.struct(F.col(ts), F.col(url)))
    return rows.groupBy("post_id").agg(best.alias("s")).select("post_id", "s.*")


def preferred(tracks: DataFrame, key: str, language: str, generated: str, translatable: str) -> DataFrame:
    """The best caption track of each key: written English, automatic English, then any that can be translated."""
    rank = F.when((F.col(language) == "en") & ~F.col(generated), 0).when(F.col(language) == "en", 1).when(F.col(translatable), 2)
    rest = [c for c in tracks.columns if c != key]
    return tracks.withColumn("__rank", rank).where("__rank is not null").groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("__rank", language)).alias("s")).select(key, "s.*")
