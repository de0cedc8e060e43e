"""Landed payloads to rows: feeds, listings and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import decode_entities


def tag(block: Column, name: str) -> Column:
    """Text of the first element of that name, with CDATA marks off and character references decoded."""
    raw = F.regexp_extract(block, f"(?s)<{name}(?:\\s[^>]*)?>(.*?)</{name}>", 1)
    return F.nullif(F.trim(decode_entities(F.regexp_replace(raw, "(?s)^\\s*<!\\[CDATA\\[(.*?)\\]\\]>\\s*$", "$1"))), F.lit(""))


def feed_date(c: Column) -> Column:
    """RFC-822 or ISO instants; anything else is null."""
    bare = F.regexp_replace(F.trim(c), "^[A-Za-z]{3},\\s*", "")
    return F.coalesce(F.try_to_timestamp(bare, F.lit("dd MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(bare))


def parse_feed(payloads: DataFrame) -> DataFrame:
    """``payloads(feed, body)`` to items in payload order: Atom if the body has entries, else RSS or RDF; items without a title or link go."""
    atom = F.col("body").rlike("<entry[\\s>]")
    blocks = F.when(atom, F.regexp_extract_all("body", F.lit("(?s)(<entry[\\s>].*?</entry>)"), F.lit(1))).otherwise(F.regexp_extract_all("body", F.lit("(?s)(<item[\\s>].*?</item>)"), F.lit(1)))
    rows = payloads.select("feed", atom.alias("atom"), F.posexplode(blocks).alias("place", "block"))
    b = F.col("block")
    link = F.when(F.col("atom"), F.regexp_extract(b, '<link[^>]*href="([^"]*)"', 1)).otherwise(tag(b, "link"))
    date = F.coalesce(feed_date(tag(b, "pubDate")), feed_date(tag(b, "updated")), feed_date(tag(b, "dc:date")))
    items = rows.select("feed", "place", tag(b, "title").alias("title"), F.nullif(link, F.lit("")).alias("link"), date.alias("ts"))
    return items.where("title is not null and link is not null")


def first_per_key(rows: DataFrame, key: list[str], arrival: str) -> DataFrame:
    """The first arrival of each key."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), arrival).alias("x")).select(*key, "x.*")


def from_json_array(payloads: DataFrame, path: str, schema: str) -> DataFrame:
    """``payloads(feed, body)`` to one row for each element of a JSON array at ``path``."""
    found = F.from_json(F.get_json_object("body", path), f"array<struct<{schema}>>", {"allowUnquotedControlChars": "true"})
    return payloads.select("feed", F.posexplode(found).alias("place", "x")).select("feed", "place", "x.*")
