"""Several values packed in one field: one row per value, with its place in the field.

Method: the field is split at quote characters, so odd pieces are literals and even pieces are delimited text; array
folds put doubled quotes back, and the pieces' values are flattened with ordinals. All of it is built-in expressions
within one projection: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Delimiters between unquoted values, with their full-width forms; white space is one as well.
DELIMITERS = ",;|/&+，；、"
#: Bracket pairs that may stand around a whole field.
BRACKETS = ("()", "[]", "{}")
#: Separates reassembled pieces; U+FDD0 is no character, so no text holds it.
MARK = "﷐"
#: White space of ASCII and of other widths (Unicode's White_Space).
ASCII_SPACE = " \t\n\x0b\f\r"
WIDE_SPACE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def packed_values(field: Column, delimiters: str = DELIMITERS) -> Column:
    """The values of a packed field, in order, as array<string>; null gives null, an empty or blank field an empty array.

    A text in double quotes is one value, a doubled quote in it stands for one; an unclosed quote runs to the end of
    the field. Empty places, also an empty pair of quotes, are no values. Repeated values are kept.
    """
    body = F.btrim(field, F.lit(ASCII_SPACE + WIDE_SPACE))
    inside = F.substring(body, F.lit(2), F.greatest(F.length(body) - 2, F.lit(0)))
    pairs = [(F.substring(body, 1, 1) == a) & (F.substring(body, -1, 1) == b) for a, b in BRACKETS]
    body = F.when((F.length(body) > 1) & (pairs[0] | pairs[1] | pairs[2]), inside).otherwise(body)
    # each further character of a class costs Java's matcher time, so text of one byte a character gets the short class
    short = "[" + "".join("\\" + c for c in delimiters if c.isascii()) + r"\s]+"
    wide = short[:-2] + "".join(c for c in delimiters if not c.isascii()) + WIDE_SPACE + "]+"

    def bare(text: Column) -> Column:
        cut = F.when(F.octet_length(text) == F.length(text), F.regexp_replace(text, short, MARK)).otherwise(F.regexp_replace(text, wide, MARK))
        return F.filter(F.split(cut, MARK), lambda v: v != "")

    pieces = F.split(body, '"', -1)
    last = F.size(pieces) - 1
    # an empty even piece between two literals is a doubled quote; other even pieces get marks around them
    joined = F.array_join(
        F.transform(
            pieces,
            lambda p, i: F.when(i % 2 == 1, p)
            .when((p == "") & (i > 0) & (i < last), F.lit('"'))
            .otherwise(F.concat(F.lit(MARK), p, F.lit(MARK))),
        ),
        "",
    )
    # now text before each odd mark is a literal and before each even mark delimited text
    runs = F.split(joined, MARK, -1)
    quoted = F.flatten(F.transform(runs, lambda r, i: F.when(i % 2 == 1, bare(r)).otherwise(F.array(r))))
    return F.when(F.contains(body, F.lit('"')), F.filter(quoted, lambda v: v != "")).otherwise(bare(body))


def explode_packed(df: DataFrame, field: str, keep: list[str], value: str = "val", position: str = "pos", delimiters: str = DELIMITERS) -> DataFrame:
    """``keep`` columns, position (int, from 1) and value, one row per value; null, empty and blank fields give no row.

    ``df`` may have columns named as the output columns are; only ``keep`` and ``field`` are read.
    """
    values = df.select(*[F.col(f"`{k}`") for k in keep], packed_values(F.col(f"`{field}`"), delimiters).alias("__values"))
    return values.select(*[F.col(f"`{k}`") for k in keep], F.posexplode("__values").alias("__at", value)).select(
        *[F.col(f"`{k}`") for k in keep], (F.col("__at") + 1).cast("int").alias(position), value
    )
