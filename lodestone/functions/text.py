"""Text expressions (F01-F14). All are built-ins, so they stay inside code generation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ends a line besides LF in Python's line splitting.
LINE_ENDS = r"\r\n|[\n\x0B\x0C\r\x1C-\x1E\x85\u2028\u2029]"
#: What Python strips as white space (the body of a Java character class).
SPACE = r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


#: The same white space without line ends, and line ends as a class body.
BLANK = r"\x09\x1F\x20\xA0\u1680\u2000-\u200A\u202F\u205F\u3000"
END = r"\n\x0B\x0C\r\x1C-\x1E\x85\u2028\u2029"
#: The line ends other than LF, as characters. Few texts hold any.
RARE_ENDS = "\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"


def normalise_newlines(text: Column) -> Column:
    """LF for CR LF and CR. Texts without CR, almost all, are left as they are."""
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def split_lines(text: Column) -> Column:
    """Lines without their ends; a final end adds no empty line."""
    parts = F.split(text, LINE_ENDS)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def count_lines(text: Column) -> Column:
    """Lines that end with LF, CR or both, and a last one without an end."""
    feeds = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    ends = F.when(F.contains(text, F.lit("\r")), F.regexp_count(text, F.lit("\r\n?|\n"))).otherwise(feeds)
    return F.when(text == "", 0).otherwise(ends + F.when(text.endswith("\n") | text.endswith("\r"), 0).otherwise(1))


def normalised_bytes(text: Column) -> Column:
    """Bytes in UTF-8 after newlines are normalised: one less for each CR LF."""
    return F.octet_length(text) - F.when(F.contains(text, F.lit("\r")), F.regexp_count(text, F.lit("\r\n"))).otherwise(0)


def is_code_line(line: Column) -> Column:
    s = strip(line)
    return (s != "") & ~s.startswith("#")


def count_code_lines(text: Column) -> Column:
    """Lines whose first visible character isn't ``#``, in one pass and without splitting the text.

    Other line ends become LF where a text holds any, an empty line more after a CR. So a line begins where ``^`` says, and
    what follows its first visible character is skipped by a class of one character: classes of many ranges, tried at every
    character, took ten times as long.
    """
    rare = F.lit(False)
    for end in RARE_ENDS:
        rare = rare | F.contains(text, F.lit(end))
    fed = F.when(rare, F.translate(text, RARE_ENDS, "\n" * len(RARE_ENDS))).otherwise(text)
    return F.regexp_count(fed, F.lit(f"(?dm)^[{BLANK}]*+[^#{SPACE}][^\\n]*+"))


def is_usable_line(line: Column, least: int = 4) -> Column:
    """At least ``least`` (two or more) characters when stripped, and no comment."""
    return line.rlike(f"(?s)^[{SPACE}]*+[^#{SPACE}].{{{least - 2},}}[^{SPACE}]")


def truncated(text: Column, limit: int = 120) -> Column:
    """One line of at most ``limit`` characters; a cut shows as an ellipsis."""
    flat = strip(F.regexp_replace(text, f"[{SPACE}]+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit - 1), F.lit("…")))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein / longer length, over code points; two empty strings are alike."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / most)


def before_first(text: Column, *markers: str) -> Column:
    """The text up to the earliest of the markers."""
    at = F.least(*(F.nullif(F.instr(text, m), F.lit(0)) for m in markers)) if len(markers) > 1 else F.nullif(F.instr(text, markers[0]), F.lit(0))
    return F.when(at.isNull(), text).otherwise(F.substring(text, F.lit(1), at - 1))


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def module_key(path: Column) -> Column:
    """The folder of a path, ``.`` for a bare name."""
    return F.when(F.instr(path, "/") == 0, ".").otherwise(F.regexp_extract(path, "^(.*)/[^/]*$", 1))


def task_seed(seed: int, task: Column) -> Column:
    """31 bits of the digest of ``seed|task``."""
    head = F.substring(sha256(F.concat(F.lit(f"{seed}|"), task)), 1, 8)
    return F.conv(head, 16, 10).cast("bigint").bitwiseAND(F.lit(0x7FFFFFFF))


def looks_binary(data: Column, sniff: int = 8192) -> Column:
    """A NUL among the first bytes."""
    return F.locate("\x00", F.substring(data, 1, sniff).cast("string")) > 0


def glob_pattern(glob: str) -> str:
    """A whole-path glob as an anchored regular expression.

    ``*``, ``?`` and ``[...]`` stay within one segment; a ``**`` segment stands for any number of
    segments, none included. Translated once on the driver.
    """
    parts, out = [p for p in glob.split("/") if p], ""
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out += "(?:[^/]+(?:/[^/]+)*)?" if last else "(?:[^/]+/)*"
            continue
        at, seg = 0, ""
        while at < len(part):
            c = part[at]
            close = part.find("]", at + 2) if c == "[" else -1
            if c == "*":
                seg += "[^/]*"
            elif c == "?":
                seg += "[^/]"
            elif close > 0:
                body = part[at + 1 : close].replace("\\", r"\\").replace("[", r"\[").replace("&", r"\&")
                seg += "[" + ("^/" + body[1:] if body[0] == "!" else body.replace("^", r"\^")) + "]"
                at = close
            else:
                seg += re.escape(c)
            at += 1
        out += seg + ("" if last else "/" if i + 1 < len(parts) - 1 or parts[-1] != "**" else "(?:/|$)")
    return f"^{out}$"


def matches_glob(path: Column, globs: list[str]) -> Column:
    hit = F.lit(False)
    for g in globs:
        hit = hit | path.rlike(glob_pattern(g))
    return hit


def percent(part: Column, whole: Column) -> Column:
    """A share with one decimal; ``N/A`` of nothing or where nothing counts."""
    return F.when((part == 0) | (whole == 0), "N/A").otherwise(F.format_string("%.1f%%", 100.0 * part / F.nullif(whole, F.lit(0))))


def privacy_label(epsilon: Column, delta: str = "1e-05") -> Column:
    """A null epsilon means that privacy is off."""
    return F.when(epsilon.isNull(), "DP off").otherwise(F.format_string(f"epsilon=%.2f delta={delta}", epsilon))
