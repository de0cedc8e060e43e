"""Landed payloads as a Spark data source, and the adapter that turns them into items by a table of feeds.

A fetcher lands what it gets as a file in its feed's folder, ``<path>/<feed>/<name>``.  ``spark.read.format("landed_payloads")`` lists the files, deals them out by size
and reads their bytes in the tasks.  What a feed is (kind, character set, publisher, tab, theme and its terms) is a row of a dimension table, so a new feed is a new row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.terms import term_hits
from . import feeds as parsers

#: Bytes of a partition.
PART = 32 << 20


def file_system(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


@dataclass
class Files(InputPartition):
    names: tuple[tuple[int, str], ...]


class LandedPayloads(DataSource):
    """Options: ``path``; ``partBytes``, the bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "landed_payloads"

    def schema(self) -> str:
        return "feed long, file string, payload binary"

    def reader(self, schema) -> DataSourceReader:
        return PayloadReader(self.options["path"], int(self.options.get("partBytes", PART)))


class PayloadReader(DataSourceReader):
    def __init__(self, path: str, part_bytes: int):
        self.path, self.part_bytes = path, part_bytes

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        files, root = file_system(self.path)
        found = sorted((x.path, x.size) for x in files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if x.is_file)
        parts, own, size = [], [], 0
        for name, n in found:
            feed = name.rsplit("/", 2)[-2]
            if not feed.isdigit() or name.rsplit("/", 1)[-1].startswith((".", "_")):
                continue
            if own and size + n > self.part_bytes:
                parts.append(Files(tuple(own)))
                own, size = [], 0
            own.append((int(feed), name))
            size += n
        return [*parts, Files(tuple(own))]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files, _ = file_system(self.path)
        for feed, name in partition.names:
            with files.open_input_stream(name) as f:
                yield pa.RecordBatch.from_arrays([pa.array([feed], pa.int64()), pa.array([name.rsplit("/", 1)[-1]]), pa.array([f.read()], pa.binary())], ["feed", "file", "payload"])


def land(payloads: DataFrame, path: str) -> None:
    """Writes ``payloads(feed, payload)`` as files named by their content, so that a task that runs again writes the same files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = file_system(path)
        for batch in batches:
            for feed, payload in zip(batch.column("feed").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                files.create_dir(f"{root}/{feed}", recursive=True)
                aside = f"{root}/{feed}/.{hashlib.sha256(payload).hexdigest()}"
                with files.open_output_stream(aside) as f:
                    f.write(payload)
                files.move(aside, aside.replace("/.", "/"))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    payloads.select("feed", "payload").mapInArrow(write, "n long").agg(F.sum("n")).collect()


ITEM = ("feed", "place", "title", "link", "ts", "points", "comments", "publisher", "tab", "theme")
#: Character sets that a feed may name; another is an error row.
CHARSETS = ("UTF-8", "ISO-8859-1", "UTF-16LE")


class SourceAdapter:
    """Items and errors of landed payloads.

    ``feeds(feed, kind, charset, publisher, tab, theme, terms)``: kind is ``feed`` (RSS, RDF or Atom, as the payload shows) or ``json`` (an array ``hits``); a null charset is
    UTF-8; a feed with terms keeps the items whose title has one of them.
    """

    def __init__(self, feeds: DataFrame, path: str, part_bytes: int = PART):
        self.spark: SparkSession = feeds.sparkSession
        self.spark.dataSource.register(LandedPayloads)
        self.feeds = feeds
        landed = self.spark.read.format("landed_payloads").option("path", path).option("partBytes", part_bytes).load()
        charset = F.coalesce("charset", F.lit("UTF-8"))
        body = F.coalesce(*(F.when(charset == c, F.try_validate_utf8(F.decode("payload", c)) if c != "UTF-8" else F.try_validate_utf8(F.col("payload").cast("string"))) for c in CHARSETS))
        known = landed.join(feeds, "feed", "left").withColumn("body", body)
        hits = F.try_variant_get(F.try_parse_json("body"), "$.hits", "array<struct<title:string,url:string,created_at:string,points:bigint,num_comments:bigint,children:array<bigint>>>")
        self.payloads = known.withColumn("hits", F.when(F.col("kind") == "json", hits))

    def errors(self) -> DataFrame:
        """(feed, file, error): payloads of unknown feeds, in another character set than said, and of another form than the feed's kind."""
        sound = F.when(F.col("kind") == "json", F.col("hits").isNotNull()).otherwise(F.col("body").rlike("<(rss|rdf:RDF|feed)[\\s>]"))
        error = F.when(F.col("kind").isNull(), "feed").when(F.col("body").isNull(), "charset").when(~sound, "payload")
        return self.payloads.select("feed", "file", error.alias("error")).where("error is not null")

    def items(self) -> DataFrame:
        feed_rows = self.payloads.where("kind = 'feed' and body is not null").select("feed", "body")
        parsed = parsers.parse_feed(feed_rows).select("feed", "place", "title", "link", "ts", F.lit(None).cast("long").alias("points"), F.lit(None).cast("long").alias("comments"))
        h = F.col("h")
        told = self.payloads.where("hits is not null").select("feed", F.posexplode("hits").alias("place", "h"))
        api = told.select("feed", "place", h["title"].alias("title"), h["url"].alias("link"), F.try_to_timestamp(h["created_at"]).alias("ts"), h["points"].alias("points"), F.coalesce(h["num_comments"], F.size(h["children"]).cast("long")).alias("comments"))
        rows = parsed.unionByName(api.where("title is not null and link is not null")).withColumn("row_id", F.xxhash64("feed", "place", "link"))
        whole = rows.join(self.feeds.drop("kind", "charset"), "feed")
        free = whole.where("terms is null or size(terms) = 0")
        asked = whole.where("size(terms) > 0")
        wanted = self.feeds.select("feed", F.explode("terms").alias("term"))
        # an item has to have a term of its own feed
        met = term_hits(asked.select(F.struct("row_id", "feed").alias("id"), F.col("title").alias("text")), wanted.select("term").distinct())
        kept = met.select("id.row_id", "id.feed", "term").join(wanted, ["feed", "term"]).select("row_id").distinct()
        return free.unionByName(asked.join(kept, "row_id", "left_semi")).select(*ITEM)
