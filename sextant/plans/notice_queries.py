"""Queries over notice texts: gates, extractors, evaluation and the posting pipeline.

Each order gives one notice; its text is put together from parts that the order's number picks, so that the SQL states what a gate or
extractor has to find from the number alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract, gates, text
from ..operators.storage import written
from ..registry import query
from ..sources import boards

#: Part of a notice: divisor of the order's number, wordings.
PARTS: dict[str, tuple[int, tuple[str, ...]]] = {
    "art": (2, ("Edital", "Edital de Concurso Público", "Retificação")),
    "sig": (1, ("Concurso Público para provimento", "Processo Seletivo Simplificado", "EXTRATO DE CONTRATO de processo seletivo", "Portaria de férias")),
    "who": (4, ("Professor Adjunto A da", "docente substituto da", "motorista da", "Professor Temporário do")),
    "inst": (16, ("Universidade Federal", "Instituto Federal", "Prefeitura Municipal", "Empresa Privada")),
    "sit": (64, ("", "Revogação de suspensão do edital", "torna sem efeito o edital", "Homologa o resultado final", "convocação de aprovados")),
    "vac": (1, ("", "2 vagas", "12 (doze) vagas", "sem número de vagas", "30 vagas")),
    "reg": (3, ("", "Dedicação exclusiva", "40 (quarenta) horas", "regime de tempo parcial")),
    "win": (5, ("", "Inscrições: de 12/08/2026 a 25/08/2026", "As inscrições serão de 2 de agosto de 2026 até 5 de março de 2027", "Inscrição até 09/10/2026", "inscrições até o dia 7 de maio de 2026", "prazo de 12/08/2026 a 25/08/2026 e de 01/09/2026 até 02/09/2026")),
    "place": (7, ("", "no Estado de São Paulo", "Campus Sorocaba/SP", "Valor DE R$ em Campus Cristalina - GO", "Estado do Lugar Nenhum")),
    "proc": (11, ("", "Processo 23105.123456/2026-11", "Processos 23105.123456/2026-11 e 23105.654321/2026-12")),
    "topic": (13, ("", "na linha de Design", "na linha de Computação")),
    "decl": (17, ("", "Área/subárea de conhecimento: Estatística Requisito(s): Design ou Computação", "Área/subárea de conhecimento: Design Requisito(s): ensino superior")),
}
NOTICES = "n as (select o_orderkey as id, o_custkey as page, o_orderdate::date as d, " + ", ".join(f"o_orderkey // {div} % {len(words)} as {name}" for name, (div, words) in PARTS.items()) + " from orders)"
#: What the texts hold, as SQL.
IS_CONTEST = "(art = 1 or sig < 2) and sig != 2"
IS_POST = "(sig < 3 and who != 2 and inst != 3)"
SEVERAL = "(proc = 2 or win = 5)"
HAS_DESIGN, HAS_COMPUTING = "(topic = 1 or decl > 0)", "(topic = 2 or decl = 1)"
FIRST_DAY = "case win when 1 then date '2026-08-12' when 2 then date '2026-08-02' end"
LAST_DAY = "case win when 1 then date '2026-08-25' when 2 then date '2027-03-05' when 3 then date '2026-10-09' when 4 then date '2026-05-07' end"
VACANCIES = "case vac when 1 then 2 when 2 then 12 when 4 then 30 end"
UF = "case place when 1 then 'SP' when 2 then 'SP' when 3 then 'GO' end"
#: Term, area and weight of the area, in the dictionary's order.
AREA_WEIGHTS = {"Design": 30, "Computação/IA": 25}
TERMS = (("design", "Design", AREA_WEIGHTS["Design"]), ("comput*", "Computação/IA", AREA_WEIGHTS["Computação/IA"]))


def part(name: str, key: Column) -> Column:
    div, words = PARTS[name]
    return F.element_at(F.array(*map(F.lit, words)), (F.floor(key / div) % len(words) + 1).cast("int"))


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    p = lambda name: part(name, F.col("o_orderkey"))
    head = F.concat_ws(" ", p("sig"), p("who"), p("inst"))
    rest = (F.nullif(p(x), F.lit("")) for x in ("sit", "vac", "reg", "win", "place", "proc", "topic", "decl"))
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("page"), F.to_date("o_orderdate").alias("d"), p("art").alias("art_type"), p("inst").alias("org"), F.concat_ws(". ", head, *rest).alias("text"))


def term_hits(text: Column) -> Column:
    return F.filter(F.array(*(F.when(gates.has_term(text, term), term) for term, _, _ in TERMS)), lambda t: t.isNotNull())


def main_area(hits: Column) -> Column:
    found = None
    for term, area, _ in sorted(TERMS, key=lambda t: -t[2]):
        found = F.when(F.array_contains(hits, term), area) if found is None else found.when(F.array_contains(hits, term), area)
    return found


@query(f"with {NOTICES} select id from n where {IS_CONTEST}")
def g01_contest_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices(spark, sf_dir).where(gates.is_contest(F.col("art_type"), F.col("text"))).select("id")


@query(f"with {NOTICES} select id from n where {IS_POST}")
def g02_regex_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teaching posts: a contest, a teacher and an institution of learning or a local authority."""
    return notices(spark, sf_dir).where(gates.is_teaching_post(F.col("text"))).select("id")


@query("select o_orderkey as id from orders where o_orderkey % 7 != 0 and o_orderkey % 5 != 4 and o_orderkey % 6 not in (2, 5)")
def g03_market_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, address and company are there, it's no talent pool, and the country is Brazil or unknown."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("id", F.col("o_orderkey"))
    company = F.when(F.col("id") % 7 != 0, "Empresa")
    kind = F.when(F.col("id") % 5 == 4, "vacancy_type_talent_pool").otherwise("vacancy_type_effective")
    country = F.get(F.array(*map(F.lit, (None, "", "Portugal", "Brasil", "Brasil", "Chile"))), (F.col("id") % 6).cast("int"))
    return o.where(gates.is_market_offer(F.lit("Dev"), F.concat(F.lit("https://x/"), F.col("id").cast("string")), company, kind, country)).select("id")


@query(f"with {NOTICES} select id, case sit when 0 then 'inscricao_aberta' when 2 then 'encerrado' else 'em_andamento' end as situation from n")
def g09_situation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices(spark, sf_dir).select("id", gates.situation(F.col("text")).alias("situation"))


@query(f"with {NOTICES} select id from n where inst = 1 and who in (0, 3) and (sig = 1 or who = 3)")
def g10_institute_substitutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices(spark, sf_dir).where(gates.is_institute_substitute(F.col("text"))).select("id")


@query(f"with {NOTICES} select id from n where {SEVERAL}")
def g11_ambiguous_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two process numbers or two date ranges speak of several items."""
    return notices(spark, sf_dir).where(gates.speaks_of_several(F.col("text"))).select("id")


def evaluated(n: DataFrame) -> DataFrame:
    """Adds passed, ambiguous and, where one item is told for sure, area, vacancies and degree."""
    n = n.withColumn("hits", term_hits(F.col("text"))).withColumn("passed", F.size("hits") > 0)
    n = n.withColumn("diverges", gates.area_diverges(F.col("text"), F.col("hits"), [t for t, _, _ in TERMS])).withColumn("ambiguous", F.col("passed") & (gates.speaks_of_several(F.col("text")) | F.col("diverges")))
    sure = lambda c: F.when(~F.col("ambiguous"), c)
    return n.withColumn("area", sure(main_area(F.col("hits")))).withColumn("vacancies", sure(extract.vacancies(F.col("text")))).withColumn("extraction", F.when(F.col("ambiguous"), "formato_nao_reconhecido"))


@query(f"with {NOTICES} select id from n where decl = 1")
def g12_area_diverges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(notices(spark, sf_dir)).where("diverges").select("id")


EVALUATED = f"""{NOTICES}, e as (select *, {HAS_DESIGN} or {HAS_COMPUTING} as passed, ({HAS_DESIGN} or {HAS_COMPUTING}) and ({SEVERAL} or decl = 1) as ambiguous from n),
v as (select *, case when passed and not ambiguous then case when {HAS_DESIGN} then 'Design' else 'Computação/IA' end end as area, case when not ambiguous then {VACANCIES} end as vacancies from e)"""


@query(f"with {EVALUATED} select id, passed, ambiguous, area, vacancies from v")
def g13_single_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(notices(spark, sf_dir)).select("id", "passed", "ambiguous", "area", "vacancies")


@query(f"with {NOTICES} select id, {VACANCIES} as vacancies from n")
def f20_vacancies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices(spark, sf_dir).select("id", extract.vacancies(F.col("text")).alias("vacancies"))


@query(f"with {NOTICES} select id, (['Dedicação exclusiva', '40 (quarenta) horas', 'regime de tempo parcial'])[reg] as regime, case when who = 0 then 'Professor Adjunto A da ' || (['Universid', 'Instituto', 'Prefeitur', 'Empresa P'])[inst + 1] end as class from n")
def f22_regime_and_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices(spark, sf_dir).select("id", extract.regime(F.col("text")).alias("regime"), extract.teaching_class(F.col("text")).alias("class"))


@query(f"with {NOTICES} select id, {FIRST_DAY} as first_day, {LAST_DAY} as last_day from n")
def f24_enrolment_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = notices(spark, sf_dir).select("id", extract.enrolment_window(F.col("text")).alias("w"))
    return w.select("id", F.col("w.first").alias("first_day"), F.col("w.last").alias("last_day"))


@query(f"with {NOTICES} select id, {UF} as uf from n")
def f25_state_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices(spark, sf_dir).select("id", extract.state_in_text(F.col("text")).alias("uf"))


@query("select o_orderkey as id, case o_orderkey % 5 when 0 then 'presencial' when 1 then 'hibrido' when 2 then 'remoto' else case when o_orderkey % 3 = 0 then 'remoto' end end as modality from orders")
def f26_modality(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    place = F.get(F.array(*map(F.lit, ("on-site", "hybrid", "remote", None, "other"))), (F.col("id") % 5).cast("int"))
    return o.select("id", extract.modality(place, F.col("id") % 3 == 0).alias("modality"))


@query(
    """with o as (select o_orderkey as id, (o_orderkey * 37 % 40000 + 0.5 * (o_orderkey % 2))::double as v, o_orderkey % 4 as k from orders)
select id, (['CLT', 'PJ', 'Estágio'])[k + 1] as contract,
  case when k != 3 then 'Até ' || case when k = 2 then 'USD ' else 'R$' end || translate(regexp_replace(format('{:,.1f}', v), '\\.0$', ''), ',.', '.,') || coalesce('/' || (['mês', 'ano', 'hora'])[k + 1], '') end as salary,
  case when k = 1 then [] else ['Python', 'SQL ' || k] end as stack from o"""
)
def f28_contract_salary_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 4).cast("int").alias("k"))
    of = lambda *x: F.get(F.array(*map(F.lit, x)), F.col("k"))
    value = F.when(F.col("k") != 3, F.col("id") * 37 % 40000 + F.lit(0.5) * (F.col("id") % 2))
    page = F.when(F.col("k") == 1, "<p>Nada</p>").otherwise(F.concat(F.lit("<p><strong>Habilidades</strong> <br> Python , SQL "), F.col("k").cast("string"), F.lit(", </p>")))
    return o.select("id", extract.contract_type(of("FULL_TIME", "CONTRACTOR", "INTERN", "OTHER")).alias("contract"), extract.salary_text(value, of("BRL", None, "USD", None), of("MONTH", "YEAR", "HOUR", None)).alias("salary"), extract.stack(page).alias("stack"))


@query("select o_orderkey as id, (['Design', 'UX/IHC', 'Computação/IA', 'Outra', 'não identificada', 'Computação/IA'])[o_orderkey % 6 + 1] as bucket from orders")
def f30_area_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.array(*map(F.lit, ("Design de Produto", "Interação humano-máquina", "Ciência da Computação", "História", None, "Inteligência Artificial")))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    return o.select("id", extract.area_bucket(F.get(labels, (F.col("id") % 6).cast("int"))).alias("bucket"))


@query("select s_suppkey as id, s_suppkey % 5 in (0, 1, 3) as collides from supplier")
def f44_acronym_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("SP", "UF Viçosa", "UFV", "MG Sul", "IF Goiano")))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("id"))
    return s.select("id", extract.collides_with_state(F.get(names, (F.col("id") % 5).cast("int"))).alias("collides"))


@query(
    """select o_orderkey as id, case when o_orderkey % 4 = 0 then 'mestrado' end as degree, case when o_orderkey % 4 in (0, 2) then (o_orderkey % 9 + 1)::varchar end as vacancies,
  case when o_orderkey % 4 = 0 then strftime(o_orderdate, '%Y-%m-%d') end as first_day from orders"""
)
def f46_checked_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a model's reply: fenced JSON, an unknown degree, an unsure field, and a reply that isn't JSON."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 4).alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    field = lambda v, sure: F.struct(v.alias("valor"), sure.alias("certeza"))
    body = F.to_json(F.struct(field(F.when(F.col("k") == 0, " Mestrado").otherwise("guru"), F.lit(True)).alias("titulacao_exigida"), field(F.col("id") % 9 + 1, F.col("k") != 1).alias("vagas"), field(F.when(F.col("k") == 0, F.col("d")).otherwise("amanhã"), F.lit(True)).alias("inscricao_inicio")))
    reply = F.when(F.col("k") == 3, "não sei").when(F.col("k") == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    r = o.withColumn("reply", reply)
    return r.select("id", extract.checked_field(F.col("reply"), "titulacao_exigida", "degree").alias("degree"), extract.checked_field(F.col("reply"), "vagas", "count").alias("vacancies"), extract.checked_field(F.col("reply"), "inscricao_inicio", "date").alias("first_day"))


# ---- the posting pipeline


def pipeline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices with a flag for each stage: the cheap gates on the preview, the area on what passed them, id and key on what is left."""
    n = notices(spark, sf_dir).withColumn("source", (F.col("id") % 3).cast("int"))
    n = n.withColumn("contest", gates.is_contest(F.col("art_type"), F.col("text"))).withColumn("post", F.col("contest") & gates.is_teaching_post(F.col("text")))
    e = evaluated(n).withColumn("relevant", F.col("post") & F.col("passed"))
    first = extract.enrolment_window(F.col("text"))["first"]
    key = F.when(F.col("area").isNotNull() & first.isNotNull(), F.concat_ws("|", "org", "area", first.cast("string")))
    return e.withColumn("first_day", first).withColumn("key", key).withColumn("uf", extract.state_in_text(F.col("text")))


STAGED = f"""{EVALUATED}, s as (select *, id % 3 as source, {IS_CONTEST} as contest, ({IS_CONTEST}) and {IS_POST} as post from v),
r as (select *, post and passed as relevant, (['Universidade Federal', 'Instituto Federal', 'Prefeitura Municipal', 'Empresa Privada'])[inst + 1] as org, {FIRST_DAY} as first_day, {UF} as uf from s),
k as (select *, case when area is not null and first_day is not null then concat_ws('|', org, area, first_day::varchar) end as key from r where relevant),
w as (select *, arg_min(source, id) over (partition by key) as first_source from k)"""


@query(f"with {STAGED} select id, org, area, uf, vacancies, first_day, key from w where key is null or source = first_source")
def v11_posting_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates, evaluation, fields and both de-duplications; of a canonical key the rows of the source that came first stay."""
    rows = written(pipeline_rows(spark, sf_dir).where("relevant").select("id", "source", "org", "area", "uf", "vacancies", "first_day", "key"), "relevant")
    firsts = rows.where("key is not null").groupBy("key").agg(F.min_by("source", "id").alias("first_source"))
    return rows.join(firsts, "key", "left").where("key is null or source = first_source").select("id", "org", "area", "uf", "vacancies", "first_day", "key")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, full): the article behind every other notice, its text followed by a table of codes, and a second table that doesn't count."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    code = F.concat(F.col("l_partkey").cast("string"), F.lit("/24."), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"))
    tables = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(F.concat(code, F.lit(" Depto")))), "</p><p>").alias("codes"))
    n = notices(spark, sf_dir).where("id % 2 = 0").join(tables, "id", "left")
    body = F.concat(F.replace("text", F.lit("<"), F.lit("&lt;")), F.lit("</p><p>Quadro I</p><p>"), F.coalesce("codes", F.lit("")), F.lit("</p><p>QUADRO II</p><p>999/24.99 Depto"))
    return n.select("id", boards.article_text(F.concat(F.lit('<div class="texto-dou">\n<html>\n<head></head>\n<body><p>'), body, F.lit("</p>\n</body></html></div>"))).alias("full"))


def posting_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of the notices that pass the gates: enriched by their article, one a code where the article is an umbrella, with fields and ids."""
    passed = written(pipeline_rows(spark, sf_dir).where("relevant").select("id", "source", "org", "area", "text", "ambiguous", "first_day", "key"), "passed-notices")
    rows = passed.join(articles(spark, sf_dir), "id", "left").withColumn("body", F.coalesce("full", "text"))
    first_table = F.split("body", "(?i)quadro\\s+ii(?![a-z0-9_])", 2)[0]
    codes = F.regexp_extract_all(first_table, F.lit("([0-9]+/[0-9]{2}\\.[0-9]{2})"), F.lit(1))
    split = rows.withColumn("codes", codes).withColumn("code", F.explode_outer(F.when(F.size("codes") >= 2, F.col("codes"))))
    link = F.concat(F.lit("https://www.in.gov.br/web/dou/-/edital-"), F.col("id").cast("string"))
    parts = [text.normalise_key(F.col("org")), text.normalise_key(F.col("area")), F.coalesce(F.col("first_day").cast("string"), F.lit("")), link, F.coalesce("code", F.lit(""))]
    posting_id = F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 20)
    fields = {"vacancies": F.when(~F.col("ambiguous"), extract.vacancies(F.col("body"))), "uf": extract.state_in_text(F.col("body"))}
    return split.withColumns(fields).select(posting_id.alias("posting_id"), "id", "source", "code", "org", "area", "uf", "vacancies", "first_day", "key", F.when(F.col("full").isNull(), "preview").otherwise("artigo").alias("origin"))


@query(
    f"""with {STAGED}, codes as (select l_orderkey as id, l_partkey || '/24.' || lpad(l_linenumber::varchar, 2, '0') as code, count(*) over (partition by l_orderkey) as n_codes from lineitem),
split as (select k.*, c.code from k left join codes c on c.id = k.id and k.id % 2 = 0 and c.n_codes >= 2),
named as (select *, substring(sha256(concat_ws('|', lower(trim(org)), lower(trim(coalesce(area, ''))), coalesce(first_day::varchar, ''), 'https://www.in.gov.br/web/dou/-/edital-' || id, coalesce(code, ''))), 1, 20) as posting_id,
  arg_min(source, id) over (partition by key) as first_source from split)
select distinct posting_id, id, code, org, area, uf, vacancies, first_day, case when id % 2 = 0 then 'artigo' else 'preview' end as origin from named where key is null or source = first_source"""
)
def v11x_posting_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline: gates, articles, umbrella split or single, fields, ids, and both de-duplications: by id, and by canonical key across sources."""
    rows = written(posting_rows(spark, sf_dir), "postings").dropDuplicates(["posting_id"])
    firsts = rows.where("key is not null").groupBy("key").agg(F.min_by("source", "id").alias("first_source"))
    return rows.join(firsts, "key", "left").where("key is null or source = first_source").select("posting_id", "id", "code", "org", "area", "uf", "vacancies", "first_day", "origin")


@query(f"with {STAGED}, c as (select source, unnest([{{'stage': 'contest', 'ok': contest, 'in': true}}, {{'stage': 'post', 'ok': post, 'in': contest}}, {{'stage': 'area', 'ok': relevant, 'in': post}}], recursive := true) from r) select stage, count_if(ok)::bigint as covered, count_if(\"in\")::bigint as total from c group by stage")
def a09_merged_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage by source and stage, merged across sources: the stage and its unit are the key."""
    stages = F.array(*(F.struct(F.lit(s).alias("stage"), F.lit("edital").alias("unit"), F.col(ok).alias("ok"), into.alias("into")) for s, ok, into in (("contest", "contest", F.lit(True)), ("post", "post", F.col("contest")), ("area", "relevant", F.col("post")))))
    each = pipeline_rows(spark, sf_dir).select("source", F.inline(stages))
    per_source = each.groupBy("source", "stage", "unit").agg(F.count_if("ok").alias("covered"), F.count_if("into").alias("total"))
    return per_source.groupBy("stage", "unit").agg(F.sum("covered").alias("covered"), F.sum("total").alias("total")).drop("unit")


@query(f"with {STAGED} select id, not contest and 1 = 1 as at_gate, case when not contest then 'contest' when not post then 'post' when not passed then 'area' end as died_at from r where id % 50 = 7")
def a30_stage_of_death(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The golden cases (every fiftieth notice) and the stage at which each one died, null if found."""
    golden = pipeline_rows(spark, sf_dir).where("id % 50 = 7")
    died = F.when(~F.col("contest"), "contest").when(~F.col("post"), "post").when(~F.col("passed"), "area")
    return golden.select("id", (~F.col("contest")).alias("at_gate"), died.alias("died_at"))


@query(f"with {NOTICES}, m as (select id, page, d, row_number() over (order by d, id) as place from n where inst = 1 and who in (0, 3) and (sig = 1 or who = 3)) select id, d, place <= 15 as sampled from m")
def t10_sampling_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 15 matching notices are sampled, the others recorded; the 15 are found by a top-k, not by a rank over all."""
    rows = written(notices(spark, sf_dir).where(gates.is_institute_substitute(F.col("text"))).select("id", "d"), "matching")
    first = rows.orderBy("d", "id").limit(15).select("id", F.lit(True).alias("sampled"))
    return rows.join(first, "id", "left").select("id", "d", F.coalesce("sampled", F.lit(False)).alias("sampled"))
