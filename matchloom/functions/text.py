"""Column builders that turn entity records into text.

Blueprint ids: H1, H2 (value clean-up), H3-H13 (pair formats s1 to s11), H15 (encoder text), P2, J12.
A record is two arrays of equal length, column names and values as strings; null means missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

#: White space as in Unicode, for Java's regular expressions.
SPACE = r"(?U)\s+"
MARKER = "COL title VAL "
LONG_TOKENS = 100


def clean_marked_title(text: Column) -> Column:
    """H1: drop every title marker, collapse white space; a record of one value."""
    return F.array(F.trim(F.regexp_replace(F.replace(text, F.lit(MARKER), F.lit("")), SPACE, " ")))


def shorten(value: Column) -> Column:
    """A text of more than 100 white-space tokens is cut before its first full stop."""
    squeezed = F.trim(F.regexp_replace(value, SPACE, " "))
    return F.when(F.size(F.split(squeezed, " ")) > LONG_TOKENS, F.substring_index(value, ".", 1)).otherwise(value)


def present(value: Column, missing: str = "NULL", numeric: bool = False, empty_as_null: bool = False) -> Column:
    """H2: the value as shown in a prompt.

    A long text is shortened; null, ``nan`` and, in a numeric column, zero become ``missing``. Empty
    strings stay unless ``empty_as_null`` (Q1).
    """
    short = shorten(value)
    absent = value.isNull() | (short == "nan")
    if numeric:
        absent = absent | (value.try_cast("double") == 0)
    if empty_as_null:
        absent = absent | (value == "")
    return F.when(absent, F.lit(missing)).otherwise(short)


def as_strings(columns: Sequence[str], prefix: str = "") -> Column:
    """Values of columns as an array of strings."""
    return F.array(*[F.col(prefix + c).cast("string") for c in columns])


class PairFormat:
    """The eleven ways to write a pair of records; ``entity`` is the noun, such as Product."""

    def __init__(self, columns: Sequence[str], a: Column, b: Column, entity: str = "Product", numeric: Sequence[str] = ()) -> None:
        self.columns, self.entity = list(columns), entity
        self.raw = {"A": [F.get(a, F.lit(k)) for k in range(len(columns))], "B": [F.get(b, F.lit(k)) for k in range(len(columns))]}
        self.numeric = [c in numeric for c in columns]

    def shown(self, side: str, missing: str = "NULL") -> list[Column]:
        return [present(v, missing, n) for v, n in zip(self.raw[side], self.numeric)]

    def _kept(self, side: str, names: bool, both: bool, missing: str = "NULL") -> Column:
        """Values (with names) of attributes that are present, on this side or on both."""
        mine, a, b = self.shown(side), self.shown("A"), self.shown("B")
        text = [F.concat(F.lit(f"{c}: "), v) if names else v for c, v in zip(self.columns, mine)]
        keep = [(x != missing) & (y != missing) if both else v != missing for v, x, y in zip(mine, a, b)]
        return F.array_join(F.array_compact(F.array(*[F.when(k, t) for k, t in zip(keep, text)])), ", ")

    def _framed(self, a: Column, b: Column) -> Column:
        return F.concat(F.lit(f'{self.entity} A is "'), a, F.lit(f'". {self.entity} B is "'), b, F.lit('". '))

    def _named(self, side: str) -> Column:
        return F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), v) for c, v in zip(self.columns, self.shown(side))])

    def _told(self, side: str) -> Column:
        return F.concat_ws(", ", *[F.concat(F.lit(f"its {c} is "), v) for c, v in zip(self.columns, self.shown(side, "missing"))])

    def s1(self) -> Column:
        return self._framed(self._named("A"), self._named("B"))

    def s2(self) -> Column:
        return self._framed(F.concat_ws(", ", *self.shown("A")), F.concat_ws(", ", *self.shown("B")))

    def s3(self) -> Column:
        return F.concat(F.lit(f"For {self.entity} A, "), self._told("A"), F.lit(f". For {self.entity} B, "), self._told("B"), F.lit(". "))

    def s4(self) -> Column:
        each = [F.concat(F.lit(f"their {c} are "), x, F.lit(" and "), y) for c, x, y in zip(self.columns, self.shown("A", "missing"), self.shown("B", "missing"))]
        return F.concat(F.lit(f"For {self.entity} A and {self.entity} B, "), F.concat_ws(", ", *each), F.lit(". "))

    def s5(self) -> Column:
        lines = [F.concat_ws("\t", F.lit(c), x, y) for c, x, y in zip(self.columns, self.shown("A"), self.shown("B"))]
        return F.concat_ws("\n", F.lit(f"Entry\t{self.entity} A\t{self.entity} B"), *lines)

    def _rows(self) -> list[Column]:
        return [F.concat_ws("\t", F.lit(f"{self.entity} {side}"), *self.shown(side)) for side in "AB"]

    def s6(self) -> Column:
        return F.concat_ws("\n", F.lit("\t".join(["Entry", *self.columns])), *self._rows())

    def s7(self) -> Column:
        return self._framed(self._kept("A", True, False), self._kept("B", True, False))

    def s8(self) -> Column:
        return self._framed(self._kept("A", False, False), self._kept("B", False, False))

    def s9(self) -> Column:
        return self._framed(self._kept("A", True, True), self._kept("B", True, True))

    def s10(self) -> Column:
        return self._framed(self._kept("A", False, True), self._kept("B", False, True))

    def s11(self) -> Column:
        return F.concat_ws("\n", *self._rows())

    def write(self, style: str) -> Column:
        """H13d: by the style's name; an unknown one is an error."""
        if style not in {f"s{k}" for k in range(1, 12)}:
            raise ValueError(f"unknown style {style!r}")
        return getattr(self, style)()


def encoder_text(columns: Sequence[str], values: Column, only: Sequence[str] | None = None) -> Column:
    """``c: v, ...`` without clean-up; a missing value reads ``nan``."""
    use = [(k, c) for k, c in enumerate(columns) if only is None or c in only]
    return F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.get(values, F.lit(k)), F.lit("nan"))) for k, c in use])


def encoder_pair_text(a: Column, b: Column, question: str) -> Column:
    return F.concat(F.lit("Entry A is "), a, F.lit(". Entry B is "), b, F.lit(f". {question}"))
