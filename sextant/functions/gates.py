"""Gates of notices and offers: what they are, whether they are open, and whether one text speaks of several."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_accents

#: Types and wording of a contest, and of the receipt of a contract.
NOTICE_TYPES = ("Edital de Concurso Público", "Edital de Processo Seletivo")
CONTEST = "concurso\\s+p[úu]blico|processo\\s+seletivo"
RECEIPT = "extratos?\\s+de\\s+(contratos?|te?rmo\\s+aditivos?|temo\\s+aditivos?)|contratante\\s*:|contratad[oa]\\s*:|locat[áa]ri[ao]\\s*:|locador\\s*:|esp[ée]cie\\s*:\\s*contrato"
#: A teacher, and an institution that may employ one.
TEACHER = "professor(a)?|docente|magist[ée]rio\\s+superior"
FEDERAL = "universidade|faculdade federal|instituto\\s+federal|centro\\s+federal\\s+de\\s+educa[cç][ãa]o\\s+tecnol[óo]gica|(?<![a-z0-9_])cefet(?![a-z0-9_])|funda[cç][ãa]o.{0,40}(ensino|educa[cç][ãa]o|universidade)|institui[cç][ãa]o(\\s+federal)?\\s+de\\s+ensino"
LOCAL = "prefeitura|c[âa]mara\\s+municipal|secretaria\\s+(de\\s+estado\\s+d[ae]|municipal\\s+d[ae]|estadual\\s+d[ae]|d[ae])\\s+educa[cç][ãa]o|autarquia\\s+municipal(\\s+de\\s+ensino)?|governo\\s+do\\s+estado"
#: Situations in their order.
SITUATIONS = (
    ("revoga[cç][aã]o\\s+d[eo]\\s+suspens[aã]o|revogar\\s+o\\s+edital\\s+de\\s+suspens[aã]o|torna\\s+sem\\s+efeito.{0,60}suspens[aã]o", "em_andamento"),
    ("revoga[cç][aã]o|torna\\s+sem\\s+efeito", "encerrado"),
    ("homologa|resultado\\s+final|resultado\\s+d[eo]\\s+(processo|concurso)|retifica[cç][aã]o\\s+d[eo]\\s+resultado|convoca[cç][aã]o|eliminad[oa]|prorroga.{0,80}validade|validade.{0,80}prorroga", "em_andamento"),
)
#: A federal institute's notice for a substitute.
INSTITUTE = "instituto federal|institui[cç][aã]o federal de educa[cç][aã]o"
SUBSTITUTE = "substitut|processo seletivo simplificado|professor(a)?\\s+tempor[áa]rio"
#: Process numbers, date ranges, and the label pair that declares an area.
PROCESS = "(?<![A-Za-z0-9_])\\d{4,6}\\.\\d{5,7}/\\d{4}-\\d{1,2}(?![A-Za-z0-9_])"
RANGE = "(?i)(?<![A-Za-z0-9_])\\d{2}/\\d{2}/\\d{4}\\s*(?:a|até)\\s*\\d{2}/\\d{2}/\\d{4}(?![A-Za-z0-9_])"
DECLARED = "(?is)Área\\s*/\\s*subárea de conhecimento:\\s*(.*?)\\s*Requisito\\(s\\):"


def says(text: Column, pattern: str) -> Column:
    return F.coalesce(text, F.lit("")).rlike(f"(?iu){pattern}")


def is_contest(art_type: Column, text: Column) -> Column:
    return (F.coalesce(art_type.isin(*NOTICE_TYPES), F.lit(False)) | says(text, CONTEST)) & ~says(text, RECEIPT)


def is_teaching_post(text: Column) -> Column:
    return says(text, f"({CONTEST})") & says(text, f"({TEACHER})") & says(text, f"({FEDERAL}|{LOCAL})")


def is_market_offer(name: Column, url: Column, company: Column, kind: Column, country: Column) -> Column:
    there = lambda c: F.coalesce(c != "", F.lit(False))
    return there(name) & there(url) & there(company) & ~kind.eqNullSafe("vacancy_type_talent_pool") & F.coalesce(country, F.lit("")).isin("", "Brasil")


def situation(text: Column) -> Column:
    found = None
    for pattern, label in SITUATIONS:
        hit = says(text, f"({pattern})")
        found = F.when(hit, label) if found is None else found.when(hit, label)
    return found.otherwise("inscricao_aberta")


def is_institute_substitute(text: Column) -> Column:
    return says(text, f"({INSTITUTE})") & says(text, f"({SUBSTITUTE})") & says(text, "professor")


def speaks_of_several(text: Column) -> Column:
    return (F.regexp_count(text, F.lit(PROCESS)) >= 2) | (F.regexp_count(text, F.lit(RANGE)) >= 2)


def has_term(text: Column, term: str) -> Column:
    """A whole word, or the head of one where the term ends in ``*``; both without accents and in lower case."""
    core = term.rstrip("*")
    quoted = "".join(c if c.isalnum() or c == " " else f"\\{c}" for c in core)
    return F.lower(strip_accents(text)).rlike(f"(?<![a-z0-9_]){quoted}" + ("" if term.endswith("*") else "(?![a-z0-9_])"))


def area_diverges(text: Column, hits: Column, terms: list[str]) -> Column:
    """A text that declares its area, with none of the terms found in the whole text inside that declaration."""
    declared = F.regexp_extract(text, DECLARED, 1)
    inside = F.lit(False)
    for term in terms:
        inside = inside | (F.array_contains(hits, term) & has_term(declared, term))
    return text.rlike(DECLARED) & ~inside
