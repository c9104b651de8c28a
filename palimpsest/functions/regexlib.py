"""Regular expressions with the semantics of an automaton-based dialect on Spark's regex engine, and match positions.

The dialect has ASCII word boundaries and classes, line anchors after a line feed only, and Unicode folding under (?i).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word boundary between ASCII word characters, whatever stands around it.
ASCII_B = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
#: Private-use sign that marks match borders; a source text's own ones are searched as another private-use sign.
MARK = ""
OTHER = "\ue001"
SPAN = "struct<text:string,start:int,end:int>"
_SPACE = r"[\t\n\f\r ]"


def translate(pattern: str) -> str:
    """A pattern of the dialect as one for Spark: word boundaries, white space, line anchors and case folding."""
    out = re.sub(r"(?<!\\)((?:\\\\)*)\\b", lambda m: m.group(1) + ASCII_B, pattern)
    out = re.sub(r"(?<!\\)((?:\\\\)*)\\s", lambda m: m.group(1) + _SPACE, out)
    out = re.sub(r"(?<!\\)((?:\\\\)*)\\S", lambda m: m.group(1) + r"[^\\t\\n\\f\\r ]".replace("\\\\", "\\"), out)
    m = re.match(r"\(\?([a-z]+)\)", out)
    flags = m.group(1) if m else ""
    body = out[m.end() :] if m else out
    new = "".join(dict.fromkeys([*flags, *("u" if "i" in flags else ""), *("d" if "m" in flags else "")]))
    return (f"(?{new})" if new else "") + body


def find_all(text: Column, pattern: str | Column, marked: str = "$0", prefix: str = "") -> Column:
    """array<struct<text, start, end>> of all matches, in code points, end exclusive; null for a null text.

    `prefix` and `marked` say what of a match is outside and inside the span, as replacement groups.
    """
    pieces = F.split(F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(OTHER)), pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(f"{prefix}{MARK}{marked}{MARK}")), MARK, -1)
    start = F.expr(f"named_struct('at', 0, 'inside', false, 'spans', cast(array() as array<{SPAN}>))")

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.length(piece)
        # the span's text is that of the source, its own private-use signs included
        own = F.when(F.contains(piece, F.lit(OTHER)), F.substring(text, acc["at"] + 1, F.length(piece))).otherwise(piece)
        span = F.struct(own.alias("text"), acc["at"].alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), (~acc["inside"]).alias("inside"), F.when(acc["inside"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(pieces, start, step, lambda acc: acc["spans"])


def count_all(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))
