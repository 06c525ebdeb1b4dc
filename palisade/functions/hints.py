"""Quick tests that spare a text the slow patterns which can't be found in it.

Java tries every alternative of a pattern at every place of a text. RE2 (in Arrow) reads the text once for a pattern, but has no lookarounds and
other notions of `$`, blanks and letters. So it tests a weaker pattern that fits wherever the pattern itself fits; a text it rules out needs no
further test, in all others the pattern itself decides.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = 63  # patterns of one hint column
_PART = re.compile(
    r"\\[pP]\{\w+\}|\\.|\[\^?\]?(?:\\[pP]\{\w+\}|\\.|[^\]\\\[])*\]|\(\?(?:<?[=!]|:|s\))|\(\?|\{(?P<low>\d+)(?P<more>,(?P<high>\d*))?\}|.", re.DOTALL
)
_ANY_CASE = re.compile(r"\(\?iu?\)")
_ODD = "[\u0130\u0131\u017f\u212a\u1c80-\u1c8f\ua640-\ua69f]"  # letters that Java takes for another one's upper or lower case, and RE2 perhaps not
_AROUND = ("(?=", "(?!", "(?<=", "(?<!")


def _end(pattern: str, start: int) -> int:
    """Where the group that opens at start is closed."""
    depth, at = 0, start
    while at < len(pattern):
        part = _PART.match(pattern, at)
        depth += part[0].startswith("(") and part[0] != "(?s)"
        depth -= part[0] == ")"
        at = part.end()
        if not depth:
            return at
    raise ValueError(f"group not closed: {pattern}")


def relaxed(pattern: str) -> str:
    """A pattern of RE2 that is found in every text in which the pattern of Java is found."""
    if flags := _ANY_CASE.match(pattern):
        return f"(?i:{relaxed(pattern[flags.end() :])})|{_ODD}"
    out, at = [], 0
    while at < len(pattern):
        part = _PART.match(pattern, at)
        x, at = part[0], part.end()
        if x in _AROUND:
            at = _end(pattern, part.start())
        elif x in ("(?", "[", "\\") or (x[0] == "\\" and x[1].isalnum() and x[1] not in "sSdDwWpPbBntr"):
            raise ValueError(f"{x} at {part.start()}: {pattern}")
        elif x in ("$", "\\b", "\\B"):
            out.append("(?:)")
        elif x[:2] in ("\\p", "\\P") or (x[0] == "[" and ("\\p" in x or "\\P" in x or "&&" in x)):
            out.append("(?s:.)")  # the Unicode versions may differ
        elif x == "\\s":
            out.append(r"[\s\x0b]")
        elif x[0] == "[":
            out.append(x.replace("\\s", "\\s\\x0b"))
        elif part["low"] is not None and (part["high"] or "0").isdigit() and int(part["high"] or 0) >= 10:
            out.append(f"{{{min(int(part['low']), 9)},}}")  # long counts make RE2 slow
        elif x == "(":
            out.append("(?:")
        else:
            out.append(x)
    return "".join(out)


def hints(text: Column, patterns: list[str]) -> Column:
    """long: the bits of the patterns that may be found in the text; null without text."""
    if len(patterns) > MOST:
        raise ValueError(f"{len(patterns)} patterns; a hint column has bits for {MOST}")
    weak = [relaxed(p) for p in patterns]

    @F.arrow_udf("long")
    def found(texts: pa.Array) -> pa.Array:
        bits = np.zeros(len(texts), np.int64)
        for i, pattern in enumerate(weak):
            bits |= np.asarray(pc.fill_null(pc.match_substring_regex(texts, pattern), False)).astype(np.int64) << i
        return pa.array(bits, mask=np.asarray(pc.is_null(texts)))

    return found(text)


def finder(text: Column, hint: Column | None, patterns: list[str]):
    """pattern -> whether it is found in the text; with a hint, which hints(text, patterns) gave, only likely texts are searched."""
    if hint is None:
        return lambda p: text.rlike(p)
    return lambda p: (hint.bitwiseAND(F.lit(1 << patterns.index(p))) != 0) & text.rlike(p)
