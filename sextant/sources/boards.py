"""Landed payloads of the posting sources to rows and to the common record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract
from ..functions.text import decode_entities, strip_accents, strip_tags
from .feeds import feed_date, tag

GAZETTE = "jsonArray array<struct<urlTitle:string,artType:string,pubDate:string,title:string,content:string,hierarchyStr:string,hierarchyList:array<string>>>"
POSTING = "`@type` string, title string, description string, hiringOrganization struct<name:string>, jobLocation struct<address:struct<addressLocality:string>>, datePosted string, validThrough string, employmentType string, baseSalary struct<value:struct<value:double,unitText:string>,currency:string>"
#: An organisation and its acronym in a post, a city's wording, longest card.
ORGANISATION = "(?s)(?<![A-Za-z0-9_])[AO]\\s+([A-ZÀ-Ý][^()]{3,140}?)\\s*\\(([A-ZÀ-Ý]{2,20})\\)"
CARD = 4000


def empty_as_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def gazette_items(pages: DataFrame) -> DataFrame:
    """``pages(page, body)`` to the items of the page's script and the volume before any filter; pages without the script give none."""
    script = F.regexp_extract("body", '(?s)<script id="params" type="application/json">(.*?)</script>', 1)
    items = pages.select("page", F.from_json(script, GAZETTE)["jsonArray"].alias("items"))
    return items.select("page", F.size("items").cast("long").alias("volume"), F.inline("items"))


def gazette_records(items: DataFrame) -> DataFrame:
    h = F.col("hierarchyList")
    return items.select(
        F.concat(F.lit("https://www.in.gov.br/web/dou/-/"), F.col("urlTitle")).alias("url"),
        F.when(F.size(h) > 1, F.get(h, 1)).otherwise(F.get(h, 0)).alias("org"),
        F.when(F.size(h) > 2, F.get(h, F.size(h) - 1)).alias("campus"),
        F.to_date(F.try_to_timestamp("pubDate", F.lit("dd/MM/yyyy"))).alias("published"),
        empty_as_null(F.col("content")).alias("text"),
    )


def article_text(html: Column) -> Column:
    body = F.regexp_extract(html, '(?s)<div class="texto-dou">\\s*<html>\\s*<head></head>\\s*<body>(.*?)</body>\\s*</html>\\s*</div>', 1)
    return empty_as_null(F.trim(F.regexp_replace(F.regexp_replace(body, "<[^>]+>", " "), "\\s+", " ")))


def blog_posts(payloads: DataFrame) -> DataFrame:
    """``payloads(feed, body)`` to posts with a link, and their arrival: the feed, then the place in it."""
    blocks = payloads.select("feed", F.posexplode(F.regexp_extract_all("body", F.lit("(?s)<item>(.*?)</item>"), F.lit(1))).alias("place", "b"))
    b = F.col("b")
    cats = F.regexp_extract_all(b, F.lit("(?s)<category><!\\[CDATA\\[(.*?)\\]\\]></category>"), F.lit(1))
    posts = blocks.select("feed", F.struct("feed", "place").alias("arrival"), tag(b, "title").alias("title"), tag(b, "link").alias("link"), feed_date(tag(b, "pubDate")).alias("ts"), cats.alias("categories"), tag(b, "content:encoded").alias("content"))
    return posts.where("link is not null")


def blog_records(posts: DataFrame) -> DataFrame:
    posts, plain = posts.withColumn("plain", strip_tags(F.col("content"))), F.col("plain")
    name, acronym = (F.regexp_extract(plain, ORGANISATION, k) for k in (1, 2))
    org = F.when(acronym != "", F.concat(acronym, F.lit(" - "), F.regexp_replace(F.trim(name), "\\s+", " "))).otherwise(F.col("title"))
    window = extract.enrolment_window(plain)
    return posts.select("link", org.alias("org"), F.to_date("ts").alias("published"), window["first"].alias("first_day"), window["last"].alias("last_day"), extract.vacancies(plain).alias("vacancies"), extract.degree(plain).alias("degree"), plain.alias("text"))


def after_icon(block: Column, icon: str) -> Column:
    found = F.regexp_extract(block, f"(?i)fa-{icon}['\"][^>]*></i>([^<]*)", 1)
    return empty_as_null(F.trim(F.regexp_replace(decode_entities(found), "\\s+", " ")))


def board_cards(pages: DataFrame) -> DataFrame:
    """``pages(page, body)``: a card reaches from its link to the next one, at most ``CARD`` characters."""
    cards = F.regexp_extract_all("body", F.lit('(?is)(<a href="/jobs/\\d+-[a-z0-9-]+".*?)(?=<a href="/jobs/\\d+-[a-z0-9-]+"|\\z)'), F.lit(1))
    rows = pages.select("page", F.explode(cards).alias("whole")).select("page", F.substring("whole", 1, CARD).alias("b"))
    b = F.col("b")
    return rows.select("page", F.regexp_extract(b, '(?i)<a href="/jobs/(\\d+)-', 1).alias("id"), empty_as_null(strip_tags(F.regexp_extract(b, "(?is)<h3[^>]*>(.*?)</h3>", 1))).alias("title"), after_icon(b, "briefcase").alias("company"), after_icon(b, "map-marker-alt").alias("place"))


def board_records(cards: DataFrame) -> DataFrame:
    p = F.trim(F.regexp_replace("place", "\\s+", " "))
    pattern = "(?i)^(.*?)\\s*\\((H[ií]brido|Remoto|Presencial)\\)\\s*$"
    label = empty_as_null(F.lower(strip_accents(F.regexp_extract(p, pattern, 2))))
    remote = p.rlike("(?i)^remoto$")
    local = F.when(~remote, F.when(label.isNotNull(), empty_as_null(F.trim(F.regexp_extract(p, pattern, 1)))).otherwise(p))
    uf = empty_as_null(F.regexp_extract(local, "^.*/([A-Z]{2})$", 1))
    city = F.when(uf.isNotNull(), F.trim(F.regexp_extract(local, "^(.*)/[A-Z]{2}$", 1))).otherwise(local)
    return cards.select("id", "title", "company", city.alias("campus"), uf.alias("uf"), F.when(remote, "remoto").otherwise(label).alias("modality"))


def job_postings(pages: DataFrame) -> DataFrame:
    """Adds ``posting``: the first JSON-LD block of type JobPosting that parses, or null."""
    blocks = F.regexp_extract_all("html", F.lit('(?s)<script type="application/ld\\+json">\\s*(.*?)</script>'), F.lit(1))
    read = F.transform(blocks, lambda b: F.from_json(b, POSTING, {"allowUnquotedControlChars": "true", "mode": "PERMISSIVE"}))
    return pages.withColumn("posting", F.get(F.filter(read, lambda p: p["@type"] == "JobPosting"), 0))


def with_details(rows: DataFrame) -> DataFrame:
    """``rows(org, uf, posting)``: the posting's fields over the listing's; rows without a posting are marked."""
    p = F.col("posting")
    locality = F.trim(p["jobLocation"]["address"]["addressLocality"])
    code = empty_as_null(F.regexp_extract(locality, "/([A-Z]{2})$", 1))
    named = extract.state_code(F.regexp_extract(locality, ",\\s*([^,]+)$", 1))
    city = F.when(code.isNotNull(), F.regexp_extract(locality, "^(.*)/[A-Z]{2}$", 1)).when(named.isNotNull(), F.regexp_extract(locality, "^(.*),\\s*[^,]+$", 1)).otherwise(locality)
    salary = p["baseSalary"]
    own = {"org": F.coalesce(p["hiringOrganization"]["name"], "org"), "uf": F.when(p.isNull(), F.col("uf")).otherwise(F.coalesce(code, named)), "campus": F.trim(city), "contract": extract.contract_type(p["employmentType"]), "salary": extract.salary_text(salary["value"]["value"], salary["currency"], salary["value"]["unitText"]), "stack": F.coalesce(extract.stack(p["description"]), F.array().cast("array<string>"))}
    return rows.withColumns(own).withColumn("origin", F.when(p.isNull(), "fallback_listagem").otherwise("json_ld"))


def contest_records(payloads: DataFrame) -> DataFrame:
    """``payloads(body)`` of nested contests: one record for each position of those that aren't closed."""
    c = payloads.select(F.from_json("body", "id long, cargos array<string>, datas struct<inicio:string,aberto:boolean>").alias("c")).where("c.datas.aberto is null or c.datas.aberto")
    return c.select("c.id", F.explode("c.cargos").alias("cargo"), F.to_date("c.datas.inicio").alias("published")).select("id", F.trim(F.regexp_replace("cargo", "\\s+", " ")).alias("code"), "published")


def remote_offers(payloads: DataFrame) -> DataFrame:
    """``payloads(body)`` of RSS items titled "Company: Role"; rows without a link, role or company go."""
    b = F.explode(F.regexp_extract_all("body", F.lit("(?s)<item>(.*?)</item>"), F.lit(1))).alias("b")
    rows = payloads.select(b)
    title = tag(F.col("b"), "title")
    at = F.instr(title, ":")
    found = rows.select(F.when(at > 0, F.trim(F.substring(title, F.lit(1), at - 1))).alias("company"), F.when(at > 0, F.trim(F.substring(title, at + 1, F.length(title)))).alias("role"), tag(F.col("b"), "link").alias("link"), tag(F.col("b"), "region").alias("region"), tag(F.col("b"), "state").alias("state"))
    return found.where("company != '' and role != '' and link is not null")


def modality_of_place(place: Column) -> Column:
    p = F.lower(strip_accents(place))
    return F.when(p.rlike("hibrido"), "hibrido").when(p.rlike("remoto|home office"), "remoto").when(p != "", "presencial")
