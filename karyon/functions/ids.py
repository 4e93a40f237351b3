"""Normal form of pedigree identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two letters, a hyphen and eight digits, in any white space (all kinds that Unicode knows).
_ID = r"(?U)\A[\s\x{FEFF}\x{200B}]*([A-Za-z]{2}-[0-9]{8})[\s\x{FEFF}\x{200B}]*\z"


def clean_id(c: Column | str) -> Column:
    """Upper-case id without white space; null for every other value."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.upper(F.regexp_extract(c, _ID, 1)), F.lit(""))


def known_parent(c: Column | str) -> Column:
    """A positive numeric parent id; null where it is unknown."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c > 0, c)
