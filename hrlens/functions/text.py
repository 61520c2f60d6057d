"""Text cleaners (Column -> Column), all native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Python's str.strip()/re "\s" sees it: Unicode White_Space
# plus the ASCII file/group/record/unit separators.
WS = r"[\p{IsWhite_Space}\x1C-\x1F]"
CASED = r"[\p{IsLowercase}\p{IsUppercase}\p{Lt}]"
# White space as characters, built from the rule rather than listed.
WS_CHARS = "".join(ch for ch in map(chr, range(0x110000)) if ch.isspace())


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace (Python ``str.strip``): a
    character-set trim, no regular expression per row."""
    return F.btrim(c, F.lit(WS_CHARS))


def clean_text(c: Column) -> Column:
    """Strip the ends and collapse every internal whitespace run to one space."""
    return F.regexp_replace(strip(c), f"{WS}+", " ")


def title_case(c: Column) -> Column:
    """Python ``str.title``: title-case the first letter of every run of cased
    letters, lower-case the rest (``o'NEIL s.PD`` -> ``O'Neil S.Pd``). Letters
    without case end a run; a letter whose upper case is two (sharp s) keeps
    one of them large.

    ``initcap`` differs: it only starts words after spaces."""
    runs = F.regexp_extract_all(c, F.lit(f"({CASED}+|[^{CASED[1:-1]}]+)"), 1)

    def titled(r: Column) -> Column:
        first = F.translate(F.upper(F.left(r, F.lit(1))), "ǄǇǊǱ", "ǅǈǋǲ")
        return F.concat(F.left(first, F.lit(1)), F.lower(F.substr(first, F.lit(2))), F.lower(F.substr(r, F.lit(2))))

    cased = F.transform(runs, titled)
    return F.when(c.isNotNull(), F.array_join(cased, ""))


def normalise_label(c: Column) -> Column:
    """Strip and title-case a label (``' active'`` -> ``Active``)."""
    return title_case(strip(c))


def clean_name(c: Column) -> Column:
    """Person names: collapse whitespace, then title-case."""
    return title_case(clean_text(c))
