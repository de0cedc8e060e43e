"""Texts against a dictionary of terms, by an equi-join on an index of their parts.

A term matches at word edges; one that ends with ``*`` matches any word, or words, that begin with it; a term may be several words.  A text gives, for each place
where a word begins, the stretches of as many words as some term has, and the beginnings as long as some prefix is; each stretch that is in the
dictionary is a hit.  So the work is linear in the text, however many terms there are, and no expression is run for each term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, strip_accents

#: A word, as term edges see it, and the places between words and the rest.
WORD = "[a-z0-9_]"
EDGE = f"(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD})"


def normalised(c: Column) -> Column:
    return F.lower(strip_accents(c))


def keyed(terms: DataFrame) -> DataFrame:
    """Terms with ``needle`` (normalised), the number of its ``words`` and, for a prefix, its ``length``, else 0."""
    needle = F.trim(normalised(F.col("term")))
    index = terms.withColumn("needle", needle).where("needle not in ('', '*')")
    length = F.when(F.endswith("needle", F.lit("*")), F.length("needle") - 1).otherwise(0)
    return index.withColumns({"words": F.regexp_count("needle", F.lit(f"{WORD}+")), "length": length})


def stretches(text: Column, sizes: list[tuple[int, int]]) -> Column:
    """The needles that a normalised text offers to terms of these (words, length), each once."""

    def at(pieces: Column, k: Column) -> Column:
        found = []
        for words, length in sizes:
            # a place beyond the end makes the stretch null
            stretch = F.concat(*(F.get(pieces, k + n) for n in range(2 * words - 1)))
            found.append(stretch if not length else F.when(F.length(stretch) >= length, F.concat(F.substring(stretch, 1, length), F.lit("*"))))
        return F.array(*found)

    places = lambda pieces: F.filter(F.sequence(F.lit(0), F.size(pieces) - 1), lambda k: F.get(pieces, k).rlike(f"^{WORD}"))
    return let(F.split(text, EDGE), lambda pieces: F.array_compact(F.array_distinct(F.flatten(F.transform(places(pieces), lambda k: at(pieces, k))))))


def term_hits(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``texts(id, text)`` and ``terms(term, …)`` to (id, term, …), each term of a text once.

    The driver sees the distinct sizes of terms.  A term that begins or ends with anything but a letter, digit or underscore has no word edges there and is an error.
    """
    index = keyed(terms)
    odd = index.where(~F.col("needle").rlike(f"^{WORD}(.*{WORD})?[*]?$")).select("term").first()
    if odd:
        raise ValueError(f"no word edges: {odd['term']}")
    sizes = sorted(map(tuple, index.select("words", "length").distinct().collect())) or [(1, 0)]
    offered = texts.where("text is not null").select("id", F.explode(stretches(normalised(F.col("text")), sizes)).alias("needle"))
    return offered.join(index, "needle").select("id", *terms.columns)
