"""Fields from free text, as ordered rules: the first that matches wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_accents

#: Patterns in their order of precedence.
DEGREES = (("doutor(ado|a|e)?(?![a-z0-9_])", "doutorado"), ("mestr(e|ado)(?![a-z0-9_])", "mestrado"), ("especializa[cç][aã]o", "especializacao"), ("(?<!projeto de )(?<!/)gradua[cç][aã]o(?![a-z0-9_])", "graduacao"))
KINDS = (("substitut[oa]|tempor[áa]ri[oa]", "substituto"), ("p[óo]s-doutorado|bolsista", "posdoc_bolsa"), ("efetiv[oa]|regime jur[íi]dico [úu]nico|carreira do magist[ée]rio", "efetivo"))
LEVELS = (("est[aá]gi[ao]?ri?[ao]?", "estagio"), ("trainee", "trainee"), ("coordenador(a)?", "coordenador"), ("ger[eê]nte", "gerente"), ("head", "head"), ("lead|l[ií]der", "lead"), ("especialista", "especialista"), ("s[eê]nior|sr\\.?", "senior"), ("pleno", "pleno"), ("j[uú]nior|jr\\.?", "junior"))
WORK_PLACES = {"on-site": "presencial", "hybrid": "hibrido", "remote": "remoto"}


def first_rule(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    found = None
    for pattern, label in rules:
        found = F.when(text.rlike(pattern), label) if found is None else found.when(text.rlike(pattern), label)
    return found


def degree(text: Column) -> Column:
    return first_rule(F.lower(text), DEGREES)


def kind(text: Column) -> Column:
    return first_rule(F.lower(text), KINDS)


def seniority(title: Column) -> Column:
    return first_rule(F.lower(title), tuple((f"(?<![a-z0-9_])({p})(?![a-z0-9_])", label) for p, label in LEVELS))


def vacancies(text: Column) -> Column:
    """The number before the first ``vaga``, words in brackets between them allowed."""
    return F.regexp_extract(text, "(?i)(\\d+)\\s*(?:\\([^)]*\\))?\\s*vaga", 1).try_cast("int")


def modality(work_place: Column, remote: Column) -> Column:
    found = None
    for k, v in WORK_PLACES.items():
        found = F.when(work_place == k, v) if found is None else found.when(work_place == k, v)
    return found.when(remote, "remoto")


#: Patterns of work regimes, teaching classes and enrolment words, months in their order.
REGIME = "dedica[cç][aã]o exclusiva|40\\s*\\(?\\s*quarenta\\s*\\)?\\s*horas|20\\s*\\(?\\s*vinte\\s*\\)?\\s*horas|regime de tempo (?:integral|parcial)"
TEACHING_CLASS = "professor(?:a)?\\s+(?:adjunto|assistente|titular|auxiliar|associado)[\\sa-záéíóúçã]{0,15}"
ENROLMENT = "inscri[cç][aã]o|inscri[cç][oõ]es"
MONTHS = "janeiro fevereiro marco abril maio junho julho agosto setembro outubro novembro dezembro".split()
#: States and their codes, what names one in a text, contract types, salary units.
STATES = {"acre": "AC", "alagoas": "AL", "amapa": "AP", "amazonas": "AM", "bahia": "BA", "ceara": "CE", "distrito federal": "DF", "espirito santo": "ES", "goias": "GO", "maranhao": "MA", "mato grosso": "MT", "mato grosso do sul": "MS", "minas gerais": "MG", "para": "PA", "paraiba": "PB", "parana": "PR", "pernambuco": "PE", "piaui": "PI", "rio de janeiro": "RJ", "rio grande do norte": "RN", "rio grande do sul": "RS", "rondonia": "RO", "roraima": "RR", "santa catarina": "SC", "sao paulo": "SP", "sergipe": "SE", "tocantins": "TO"}
NAMED_STATE = "(?iu)(?<![A-Za-z0-9_])estado\\s+d[eoa]\\s+([A-ZÀ-Ý][a-zà-ÿ]+(?:\\s+[a-zà-ÿ]{1,4}\\s+[A-ZÀ-Ý][a-zà-ÿ]+|\\s+[A-ZÀ-Ý][a-zà-ÿ]+){0,3})"
CITY_AND_CODE = "(?<![A-Za-z0-9_])[A-ZÀ-Ý][a-zà-ÿ]+(?:\\s+(?:d[eoa]s?|[A-ZÀ-Ý][a-zà-ÿ]+)){0,3}\\s*[-/]\\s*([A-Z]{2})(?![A-Za-z0-9_])"
CONTRACTS = {"FULL_TIME": "CLT", "CONTRACTOR": "PJ", "INTERN": "Estágio"}
UNITS = {"MONTH": "mês", "YEAR": "ano", "WEEK": "semana", "DAY": "dia", "HOUR": "hora"}
#: Area labels by pattern, in their order.
AREAS = (("design", "Design"), ("ux|ihc|intera[çc]", "UX/IHC"), ("comput|intelig[êe]ncia artificial|/ia|aprendizado de m|tecnologia da informa|sistemas de informa|engenharia de software|ci[êe]ncia da computa", "Computação/IA"))


def looked_up(key: Column, names: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), key)


def found_text(text: Column, pattern: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, f"(?iu)({pattern})", 1)), F.lit(""))


def regime(text: Column) -> Column:
    return found_text(text, REGIME)


def teaching_class(text: Column) -> Column:
    return found_text(text, TEACHING_CLASS)


def enrolment_window(text: Column) -> Column:
    """Struct (first, last): a numeric range, a range in words, a last day as a number or in words; the first form that reads wins."""
    near = f"(?iu)(?:{ENROLMENT})[^.]{{0,150}}?"
    number, said = "(\\d{2})/(\\d{2})/(\\d{4})", "(\\d{1,2})\\s+de\\s+([a-zçãóé]+)\\s+de\\s+(\\d{4})"

    def day(pattern: str, first: int, words: bool) -> Column:
        d, m, y = (F.regexp_extract(text, near + pattern, first + k) for k in range(3))
        if words:
            m = F.array_position(F.array(*map(F.lit, MONTHS)), F.translate(F.lower(m), "ç", "c")).cast("string")
        return F.to_date(F.try_to_timestamp(F.when(y != "", F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))), F.lit("yyyy-MM-dd")))

    none = F.lit(None).cast("date")
    forms = [(f"{number}[^\\d]{{1,10}}(?:a|até)[^\\d]{{0,10}}{number}", False, True), (f"de\\s+{said}\\s+(?:a|até)\\s+{said}", True, True), (f"at[ée][^\\d]{{0,10}}{number}", False, False), (f"at[ée]\\s+(?:o\\s+dia\\s+)?{said}", True, False)]
    read = []
    for pattern, words, both in forms:
        first, last = (day(pattern, 1, words), day(pattern, 4, words)) if both else (none, day(pattern, 1, words))
        read.append(F.when(last.isNotNull() & (first.isNotNull() if both else F.lit(True)), F.struct(first.alias("first"), last.alias("last"))))
    return F.coalesce(*read, F.struct(none.alias("first"), none.alias("last")))


def state_code(name: Column) -> Column:
    return looked_up(F.trim(F.regexp_replace(F.lower(strip_accents(name)), "\\s+", " ")), STATES)


def state_in_text(text: Column) -> Column:
    """The state that a text names, else the first valid code after a city."""
    codes = F.filter(F.regexp_extract_all(text, F.lit(CITY_AND_CODE), F.lit(1)), lambda c: c.isin(*STATES.values()))
    return F.coalesce(state_code(F.regexp_extract(text, NAMED_STATE, 1)), F.get(codes, 0))


def contract_type(kind: Column) -> Column:
    return looked_up(kind, CONTRACTS)


def salary_text(value: Column, currency: Column, unit: Column) -> Column:
    """``Até R$18.000/mês``: points between thousands, a comma before decimals."""
    amount = F.translate(F.call_function("format_number", value, F.lit("#,##0.###")), ",.", ".,")
    sign = F.when(F.coalesce(currency, F.lit("BRL")) == "BRL", "R$").otherwise(F.concat(currency, F.lit(" ")))
    return F.when(value.isNotNull() & ~F.isnan(value), F.concat(F.lit("Até "), sign, amount, F.coalesce(F.concat(F.lit("/"), looked_up(unit, UNITS)), F.lit(""))))


def stack(description: Column) -> Column:
    listed = F.regexp_extract(description, "(?i)<strong>Habilidades</strong>\\s*<br>\\s*([^<]+)", 1)
    return F.filter(F.transform(F.split(listed, ","), lambda x: F.trim(x)), lambda x: x != "")


def area_bucket(label: Column) -> Column:
    low = F.lower(F.coalesce(label, F.lit("")))
    return F.when(low == "", "não identificada").otherwise(F.coalesce(first_rule(low, AREAS), F.lit("Outra")))


def collides_with_state(acronym: Column) -> Column:
    """True if a short name is, or begins with, a state's code or ``UF``."""
    s = F.trim(acronym)
    return s.startswith("UF ") | F.split_part(s, F.lit(" "), F.lit(1)).isin(*STATES.values())


def checked_field(reply: Column, name: str, kind: str) -> Column:
    """A field ``{valor, certeza}`` of a model's JSON reply (its fence taken off), as text; null unless certain and of its kind."""
    bare = F.regexp_replace(F.trim(reply), "(?is)^```(?:json)?\\s*(.*?)\\s*```$", "$1")
    value = F.trim(F.get_json_object(bare, f"$.{name}.valor"))
    sure = F.get_json_object(bare, f"$.{name}.certeza") == "true"
    if kind == "degree":
        value = F.lower(value)
        good = value.isin("doutorado", "mestrado", "especializacao", "graduacao")
    elif kind == "count":
        number = value.try_cast("double")
        value, good = F.round(number).cast("long").cast("string"), number > 0
    elif kind == "date":
        good = value.rlike("^\\d{4}-\\d{2}-\\d{2}$")
    else:
        good = value != ""
    return F.when(sure & good, value)
