"""URL columns: canonical links, registered domains and slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_accents

#: Query parameters that only track, and second-level suffixes.
TRACKING = "(?i)^(utm_[^=]*|cmp|ref|fbclid|gclid|src|source)(=|$)"
TWO_LEVEL = ("co.uk", "com.br", "org.br", "gov.br", "net.br", "ac.uk", "co.jp", "com.au")


def canonical_link(c: Column) -> Column:
    """Without tracking parameters, fragment, ``www.`` and a last slash; what isn't a URL stays as it is."""
    raw = F.trim(c)
    bare = F.regexp_replace(raw, "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1)), "^www\\.", "")
    path = F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1)
    path = F.when(path == "", "/").otherwise(path)
    query = F.array_join(F.filter(F.split(F.regexp_extract(bare, "\\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)), "&")
    link = F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    short = F.when(path != "/", F.regexp_replace(link, "/$", "")).otherwise(link)
    return F.when(host != "", short).otherwise(F.when(raw != "", raw))


def registered_domain(c: Column) -> Column:
    host = F.regexp_replace(F.lower(F.regexp_extract(F.trim(c), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)), "^www\\.", "")
    two = F.substring_index(host, ".", -2)
    return F.when(host != "", F.when(two.isin(*TWO_LEVEL), F.substring_index(host, ".", -3)).otherwise(two))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(strip_accents(c))), "[^a-z0-9\\s-]+", ""), "\\s+", "-")
