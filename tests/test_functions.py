from pyspark.sql import functions as F

from sextant import queries
from sextant.functions import extract, scoring, text, urls
from sextant.operators import clusters
from sextant.sources import feeds


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


def test_accents_and_titles(spark):
    assert one(spark, "Ação É ÜBER ñ", lambda c: F.lower(text.strip_accents(c))) == "acao e uber n"
    assert one(spark, "  Olá,   mundo! 9.6 ", text.normalise_title) == "ola, mundo 9.6"
    assert one(spark, "Fundação Casa-Grande", text.institution_key) == "casa grande"


def test_anchors_by_regime(spark):
    assert one(spark, "O Governo do Brasil aprova escala 6x1 em 8 cidades, alta de 9,6", text.anchors) == ["governo", "brasil", "6x1", "9.6"]
    assert one(spark, "GOVERNO APROVA ESCALA NACIONAL", text.anchors) == ["governo", "aprova", "escala", "nacional"]
    assert one(spark, "", text.anchors) == []


def test_links_and_domains(spark):
    link = lambda u: one(spark, u, urls.canonical_link)
    assert link("HTTPS://WWW.Ex.com/a/?utm_source=x&b=1&ref=2#f") == "https://ex.com/a/?b=1"
    assert link("https://ex.com/") == "https://ex.com/" and link("https://ex.com/a/") == "https://ex.com/a"
    assert link("no url") == "no url" and link("  ") is None
    assert one(spark, "http://g1.globo.com/x", urls.registered_domain) == "globo.com"
    assert one(spark, "http://feeds.bbci.co.uk", urls.registered_domain) == "bbci.co.uk"


def test_degree_and_kind(spark):
    degree = lambda t: one(spark, t, extract.degree)
    assert degree("Doutorado ou mestrado") == "doutorado" and degree("projeto de graduação") is None
    assert degree("Faculdade/Graduação em X") is None and degree("exige graduação") == "graduacao"
    assert one(spark, "Professor substituto efetivo", extract.kind) == "substituto"
    assert one(spark, "Gerente Sênior", extract.seniority) == "gerente"


def test_points_at_their_edges(spark):
    rows = spark.createDataFrame([(k, d) for k, d in enumerate(["2024-01-10", "2024-01-09", "2024-01-17", "2024-01-18", "2024-01-25", "2024-01-26", "2024-02-09", "2024-02-10", None])], "k int, d string")
    now = F.lit("2024-01-10").cast("date")
    found = rows.orderBy("k").select(scoring.urgency_points(F.col("d").cast("date"), now).alias("u")).collect()
    assert [r.u for r in found] == [15, 2, 15, 12, 12, 9, 9, 5, 7]


def test_pairs_at_the_edge_of_the_window(spark):
    rows = [(1, "2024-01-01 00:00:00", "x"), (2, "2024-01-02 12:00:00", "y"), (3, "2024-01-02 12:00:01", "z"), (4, None, "w"), (5, "2024-01-01 00:00:00", "x")]
    items = spark.createDataFrame([(i, "ia", "pt", d, t, ["a", "b", "c"]) for i, t, d in rows], "id long, tab string, lang string, domain string, ts string, anchors array<string>").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r.a, r.b) for r in clusters.similar_pairs(items).collect()) == [(1, 2), (1, 5), (2, 3), (2, 5)]
    assert {r.id: r.cluster for r in clusters.clustered(items).collect()} == {1: 1, 2: 1, 3: 1, 5: 1, 4: 4}


def test_feeds_of_both_kinds(spark):
    rss = "<rss><item a='1'><title><![CDATA[A &amp;amp; B]]></title><link>http://x/1</link><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate></item><item><title>No link</title></item></rss>"
    atom = "<feed><entry><title>C</title><link href='q' rel=\"x\" href=\"http://x/2\"/><updated>2024-01-02T00:00:00Z</updated></entry></feed>"
    found = feeds.parse_feed(spark.createDataFrame([(1, rss), (2, atom), (3, None)], "feed int, body string")).orderBy("feed").collect()
    assert [(r.feed, r.title, r.link, str(r.ts)) for r in found] == [(1, "A &amp; B", "http://x/1", "2024-01-01 10:00:00"), (2, "C", "http://x/2", "2024-01-02 00:00:00")]


def test_pages_keep_no_reference_of_the_further_names(spark, tmp_path):
    html = "<p>&copy; 2024&nbsp;&middot; a&MIDDOT;b &amp;copy; &copyx; &bullet;</p>"
    spark.createDataFrame([(1, html)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert queries.queries()["f16_strip_tags"](spark, str(tmp_path)).first()["plain"] == "© 2024 · a·b &copy; &copyx; &bullet;"
    assert one(spark, "&copy; &middot; &lt;", text.decode_entities) == "&copy; &middot; <"
