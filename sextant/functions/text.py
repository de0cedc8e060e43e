"""Text columns: accents, titles, tokens, numbers, anchors and mark-up."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks and their bare forms.
MARKED = "".join(c for c in map(chr, range(0xC0, 0x250)) if len(d := unicodedata.normalize("NFD", c)) > 1 and ord(d[0]) < 0x250)
BARE = "".join(unicodedata.normalize("NFD", c)[0] for c in MARKED)
TOKEN_EDGE = "[^\\p{L}\\p{N}'’-]+"
NUMBER = "(?i)[0-9]+(?:[.,][0-9]+)*x[0-9]+(?:[.,][0-9]+)*|[0-9][0-9.,]*"
#: Words that never anchor a title.
STOP_WORDS_PT = "a ao aos as à às com como da das de del desde do dos e ele ela eles elas em entre era essa esse esta este eu foi foram há isso isto já lhe mais mas me mesmo meu minha muito na nas nem no nos nós não num numa o os ou para pela pelas pelo pelos por porque qual quando que quem se sem ser seu sua são só sobre também te tem têm ter teu tua um uma uns umas vai ver você após ante até contra diz disse pode vão deve ainda apos sao nao ja ha so apenas antes depois durante veja saiba entenda confira leia agora hoje ontem anos ano dia dias novo nova".split()
STOP_WORDS_EN = "the an and or but if of on in to for with without from by at as is are was were be been being it its this that these those he she they them his her their we you your our not no yes has have had will would can could should may might must do does did more most new how why what when where who which about after before over under into out up down than then there here all some one two says said say just now get gets via amid set sets".split()
STOP_WORDS = STOP_WORDS_PT + STOP_WORDS_EN
#: Character references by name and number, in their order; the ampersand comes after all numbers.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&#039;": "'", "&#34;": '"', "&#034;": '"', "&#8217;": "\u2019", "&#8216;": "\u2018", "&#8220;": "\u201c", "&#8221;": "\u201d", "&#8211;": "\u2013", "&#8212;": "\u2014", "&#160;": " "}
#: Names beyond that list, for whole pages only.
PAGE_ENTITIES = {"&copy;": "©", "&middot;": "·"}


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value worked out once."""
    return F.get(F.transform(F.array(value), then), 0)


def strip_accents(c: Column) -> Column:
    return F.translate(c, MARKED, BARE)


def normalise_key(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def normalise_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(strip_accents(c)), "[^\\p{L}\\p{N},.]+", " "), " +", " "))


def institution_key(c: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]+", " "))
    return F.regexp_replace(plain, "^fundacao ", "")


def tokens(c: Column) -> Column:
    """Tokens with their case, inner apostrophes and hyphens kept."""
    cut = F.transform(F.split(c, TOKEN_EDGE), lambda t: F.regexp_replace(t, "^['’-]+|['’-]+$", ""))
    return F.filter(cut, lambda t: t != "")


def is_shouting(c: Column, limit: float = 0.6) -> Column:
    """True if over ``limit`` of the tokens of six letters and more are upper-case."""
    return let(tokens(c), lambda own: _shout(own, limit))


def _shout(own: Column, limit: float = 0.6) -> Column:
    long = F.filter(own, lambda t: t.rlike("\\p{L}") & (F.length(t) >= 6))
    loud = lambda t: (t == F.upper(t)) & (t != F.lower(t))
    return let(long, lambda x: F.coalesce(F.try_divide(F.size(F.filter(x, loud)), F.size(x)) > limit, F.lit(False)))


def numbers(c: Column) -> Column:
    """Numbers as anchors: decimal commas as points, single digits left out."""
    found = F.transform(F.regexp_extract_all(c, F.lit(f"({NUMBER})"), F.lit(1)), lambda n: F.lower(F.replace(F.regexp_replace(n, "[.,]+$", ""), F.lit(","), F.lit("."))))
    return F.filter(found, lambda n: ~n.rlike("^[0-9]?$"))


def anchors(c: Column) -> Column:
    plain = lambda t: F.lower(strip_accents(t))
    named = lambda own, first, least: F.filter(F.transform(F.filter(own, lambda t: t.rlike(first)), plain), lambda t: (F.length(t) >= least) & ~t.isin(STOP_WORDS))
    kept = let(tokens(c), lambda own: F.when(_shout(own), named(own, "\\p{L}", 4)).otherwise(named(own, "^\\p{Lu}", 2)))
    return F.array_distinct(F.concat(kept, numbers(c)))


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(common, F.size(a) + F.size(b) - common), F.lit(0.0))


def _code_point(digits: Column, base: int) -> Column:
    """The character of a number, nothing outside Unicode; beyond the basic plane a pair of halves, as UTF-16 has it."""
    n = F.conv(F.when(F.length(digits) <= 8, digits), base, 10).try_cast("long")
    high, low = F.lit(0xD800) + F.shiftright(n - 0x10000, 10), F.lit(0xDC00) + (n - 0x10000) % 0x400
    utf16 = lambda c: F.lpad(F.hex(c), 4, "0")
    units = F.when(n < 0x10000, utf16(n)).otherwise(F.concat(utf16(high), utf16(low)))
    return F.when((n > 0) & (n < 0x110000), F.decode(F.unhex(units), "UTF-16BE")).otherwise("")


def _replaced(c: Column, pattern: str, letter: Callable[[Column], Column]) -> Column:
    """Splits at the ampersands; a piece whose head fits the pattern gives way to its ``letter``, if that isn't null."""

    def piece(p: Column) -> Column:
        return let(F.regexp_extract(p, f"^({pattern});", 1), lambda head: F.coalesce(F.when(head != "", F.concat(letter(head), F.substring(p, F.length(head) + 2, F.length(p)))), F.concat(F.lit("&"), p)))

    return let(F.split(c, "&", -1), lambda cut: F.concat(F.get(cut, 0), F.array_join(F.transform(F.slice(cut, F.lit(2), F.size(cut)), piece), "")))


def decode_entities(c: Column, more: dict[str, str] | None = None) -> Column:
    """Named references (``more`` beside the list) and decimal ones, then hexadecimal ones; the ampersand last: &amp;lt; stays a reference."""
    names = F.create_map(*(F.lit(x) for name, letter in (ENTITIES | (more or {})).items() if "#" not in name for x in (name[1:-1], letter)))
    first = lambda head: F.when(F.startswith(head, F.lit("#")), _code_point(F.substring(head, 2, 20), 10)).otherwise(F.element_at(names, F.lower(head)))
    decoded = lambda x: F.regexp_replace(_replaced(_replaced(x, "[a-zA-Z]{2,6}|#[0-9]+", first), "#[xX][0-9a-fA-F]+", lambda head: _code_point(F.substring(head, 3, 20), 16)), "(?i)&amp;", "&")
    return let(c, lambda x: F.when(x.contains("&"), decoded(x)).otherwise(x))


def strip_tags(c: Column, more: dict[str, str] | None = None) -> Column:
    return F.trim(F.regexp_replace(decode_entities(F.regexp_replace(c, "<[^>]+>", " "), more), "\\s+", " "))


def truncated(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def keyword_window(c: Column, word: str, before: int = 1200, after: int = 7000, whole: int = 8000) -> Column:
    """The text around the first place of a word; short texts whole, and the head where the word is missing."""
    at = F.instr(F.lower(c), word)
    start = F.greatest(F.lit(1), at - before)
    return F.when(F.length(c) <= whole, c).when(at > 0, F.substring(c, start, at - start + after)).otherwise(F.substring(c, F.lit(1), F.lit(whole)))
