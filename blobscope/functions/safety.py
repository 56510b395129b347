"""Text that is safe to show in a terminal or to open in a spreadsheet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: CSI to its final byte, OSC to BEL or ESC \ (or to the end if unfinished), lone ESC, other controls but
#: tab and line ends.
_ESCAPES = r"(?s)\x1B\[[^\x40-\x7E]*(?:[\x40-\x7E]|\z)|\x1B\].*?(?:\x07|\x1B\\|\z)|\x1B|[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"


def is_formula(text: Column) -> Column:
    """Whether a spreadsheet may read the text as a formula: = + - or @ after white space."""
    return text.rlike(r"^(?U)\s*[=+\-@]")


def escape_formula(text: Column) -> Column:
    return F.when(is_formula(text), F.concat(F.lit("'"), text)).otherwise(text)


def scrub_terminal(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPES, "")
