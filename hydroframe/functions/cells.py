"""Cells of station files: null words, type codes and guarded casts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell texts that mean "no value".
NULL_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# The last letter of a type code and the Spark type it stands for.
TYPE_LETTERS = {"s": "string", "n": "double", "d": "timestamp_ntz"}


def spark_type(code: str) -> str:
    """Spark type of a type code such as `15s`, `16n` or `20d`."""
    try:
        return TYPE_LETTERS[code[-1:]]
    except KeyError:
        raise ValueError(f"unknown type code {code!r}") from None


def known_code(code: Column) -> Column:
    """True where a type code ends in one of the known letters."""
    return F.coalesce(F.right(code, F.lit(1)).isin(*TYPE_LETTERS), F.lit(False))


def text_cell(cell: Column) -> Column:
    """The cell, or null for a null word."""
    return F.when(~cell.isin(*NULL_WORDS), cell)


def number_cell(cell: Column) -> Column:
    """The cell as double; null for null words and for tokens that are no number.

    try_cast alone would also take `1d`, `1f`, `0x1p3`, `inf` and `nan`. Plain comparisons
    keep them out; a pattern would cost as much as the rest of the cell.
    """
    token = F.trim(cell)
    plain = (
        F.left(token, F.lit(1)).between("+", "9")
        & F.right(token, F.lit(1)).between(".", "9")
        & ~token.contains("x")
        & ~token.contains("X")
    )
    return F.when(plain, token.try_cast("double"))


def time_cell(cell: Column) -> Column:
    """The cell as local time; a year or a month means its first instant."""
    return F.trim(cell).try_cast("timestamp_ntz")


def is_bad(cell: Column, typed: Column) -> Column:
    """True where a cell holds a token its type cannot represent."""
    return typed.isNull() & text_cell(F.trim(cell)).isNotNull()


def typed_cell(cell: Column, code: str, strict: bool = False, what: str = "cell") -> Column:
    """The cell cast by its type code; in strict mode a bad token fails the query."""
    kind = spark_type(code)
    if kind == "string":
        return text_cell(cell)
    typed = number_cell(cell) if kind == "double" else time_cell(cell)
    if strict:
        complaint = F.concat(F.lit(f"{what}: not a {kind}: "), cell)
        typed = F.when(is_bad(cell, typed), F.raise_error(complaint).cast(kind)).otherwise(typed)
    return typed
