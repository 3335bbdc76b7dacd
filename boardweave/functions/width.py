"""Text folding shared by every operator that compares typed strings.

All expressions are built-in Spark functions, so they stay inside
whole-stage code generation.
"""

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full-width ASCII (U+FF01..U+FF5E) and its half-width counterpart, by rule.
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
HALF_WIDTH = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "

#: Everything that is neither a letter nor a number, in any script.
NON_WORD = r"[^\p{L}\p{N}]+"


def half_width(text: Column) -> Column:
    """Full-width ASCII and the ideographic space as their ASCII forms; null stays null."""
    return F.translate(text, FULL_WIDTH, HALF_WIDTH)


def folded(text: Column) -> Column:
    """Letters and digits of ``text``, half-width and in lower case; null becomes ''."""
    return F.regexp_replace(F.lower(half_width(F.coalesce(text, F.lit("")))), NON_WORD, "")


def fold_py(text: str) -> str:
    """The same folding for Python code that works on whole Arrow batches."""
    return regex.sub(NON_WORD, "", text.translate(_TABLE).lower())


_TABLE = {ord(a): b for a, b in zip(FULL_WIDTH, HALF_WIDTH)}
