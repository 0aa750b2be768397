"""Glob patterns and the lines of rule files."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_to_regex(pattern: str) -> str:
    """An anchored regular expression, for which a line end is a character like any other. `*` and `?` match slashes too; `**` stands for any run of components; `[..]`
    and `{a,b}` are classes and alternatives. Works for Java and RE2 alike."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c, rest = pattern[i], pattern[i:]
        if rest.startswith("**/") and i == 0:
            out, i = out + "(?:.*/)?", i + 3
        elif rest.startswith("/**/"):
            out, i = out + "/(?:.*/)?", i + 4
        elif rest == "/**":
            out, i = out + "/.+", i + 3
        elif c == "*":
            out, i = out + ".*", i + (2 if rest.startswith("**") else 1)
        elif c == "?":
            out, i = out + ".", i + 1
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            negated = body[:1] in "!^"
            body = body[1:] if negated else body
            for special in "\\[&~":
                body = body.replace(special, "\\" + special)
            out, i = out + ("[^" if negated else "[") + body + "]", end + 1
        elif c == "{":
            out, i, depth = out + "(?:", i + 1, depth + 1
        elif c == "}" and depth:
            out, i, depth = out + ")", i + 1, depth - 1
        elif c == "," and depth:
            out, i = out + "|", i + 1
        elif c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + (re.escape(c) if not c.isalnum() and c.isascii() and c not in "/_ " else c), i + 1
    return f"(?s)\\A{out}\\z"  # names may hold line ends


@dataclass(frozen=True)
class Rule:
    """tier 0: the command line's; tier 1: an ignore file's, which hold below `scope`."""

    tier: int
    ord: int
    action: str
    pattern: str
    scope: str = ""
    origin: str = ""

    @property
    def regex(self) -> str:
        return glob_to_regex(self.pattern)


def rule_parse(line: Column, default_action: str = "exclude") -> Column:
    """struct(action, pattern) of a line; null for blank lines and comments. `+ ` includes, `- ` and no sign exclude
    (or the default), `!` includes."""
    text = F.trim(line)
    put = lambda action, pattern: F.struct(F.lit(action).alias("action"), F.trim(pattern).alias("pattern"))
    return (
        F.when((text == "") | F.startswith(text, F.lit("#")), F.lit(None))
        .when(F.startswith(text, F.lit("+ ")), put("include", F.substring(text, 3, 1 << 20)))
        .when(F.startswith(text, F.lit("- ")), put("exclude", F.substring(text, 3, 1 << 20)))
        .when(F.startswith(text, F.lit("!")), put("include", F.substring(text, 2, 1 << 20)))
        .otherwise(put(default_action, text))
    )
