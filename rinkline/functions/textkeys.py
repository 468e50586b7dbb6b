"""Column expressions that make keys of names and free text, all of them JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks that part words: the no-break space and the thin space are typed as often as the plain one.
BLANKS = "\u00a0\u2009"


def word_parts(c: Column) -> Column:
    """Lower-cased runs of letters and digits of a text, in order; null gives null, an empty text an empty array."""
    return F.filter(F.split(F.lower(F.upper(c)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def writing_key(c: Column) -> Column:
    """Equal for texts that differ only in letter case, blanks, punctuation and the order of their parts."""
    return F.array_join(F.array_sort(word_parts(c)), " ")


def ascii_key(c: Column) -> Column:
    """Equal for spellings of one name that differ in writing or in decoding.

    Reading bytes with a wrong character set, or losing characters to ``?`` or U+FFFD, changes runs of characters beyond
    ASCII into other such runs (or ``?``) and leaves ASCII letters alone; so the runs of ASCII letters and digits
    between them, sorted, are what all stored forms of one typed name share. A name without any (another script) is its
    own lower-cased text; null gives ''.
    """
    bag = F.ltrim(F.array_join(F.array_sort(F.split(F.lower(c), "[^a-z0-9]+")), " "))
    return F.coalesce(F.nullif(bag, F.lit("")), F.lower(c), F.lit(""))


#: Letters beyond ASCII that names of the domain are typed with.
NAME_LETTERS = "åäöéüøæëèáíóúçñÅÄÖÉÜØÆ"


def typed_key(c: Column) -> Column:
    """The writing key of a name whose letters can be told: null where some are damaged, lost or unusual."""
    rest = F.translate(c, NAME_LETTERS, "")
    return F.when((F.octet_length(rest) == F.length(rest)) & ~c.contains("?"), writing_key(c))


def trimmed_lower(c: Column) -> Column:
    """Without regard to case and outer whitespace of any kind."""
    return F.lower(F.regexp_replace(c, rf"^[\s{BLANKS}]+|[\s{BLANKS}]+$", ""))


def exact_state(*columns: str) -> Column:
    """The values of several columns as one text: equal exactly when all columns are, null counting as a value."""
    return F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns])
