"""Column functions on text: lengths, token estimates, tags, paths, labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 code units (an astral character counts twice)."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def token_count(c: Column) -> Column:
    """MTH-1: a quarter of the UTF-16 length, rounded half up; null and empty are 0."""
    return F.coalesce(F.floor(utf16_length(c) / F.lit(4.0) + F.lit(0.5)), F.lit(0)).cast("long")


def joined_token_count(texts: Column) -> Column:
    """MTH-2: tokens of an array of texts, joined by a space; nulls are left out."""
    return token_count(F.array_join(texts, " "))


def truncate(c: Column, most: int) -> Column:
    """STR-3: text longer than ``most`` keeps most - 3 characters and three dots."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def format_tokens(n: Column) -> Column:
    """MTH-6: from a thousand on ``x.yK``, without a zero decimal; half up."""
    tenths = F.floor(n / F.lit(100.0) + F.lit(0.5)).cast("long")
    whole, rest = F.floor(tenths / 10).cast("string"), F.pmod(tenths, F.lit(10)).cast("string")
    return F.when(n >= 1000, F.when(rest == "0", F.concat(whole, F.lit("K"))).otherwise(F.concat(whole, F.lit("."), rest, F.lit("K")))).otherwise(n.cast("string"))


def format_duration(ms: Column) -> Column:
    """Milliseconds as seconds, minutes and seconds, or hours and minutes; null stays null."""
    s = F.floor(ms / 1000).cast("long")
    part = lambda a, u: F.concat(a.cast("string"), F.lit(u))
    m, h = F.floor(s / 60).cast("long"), F.floor(s / 3600).cast("long")
    return F.when(s < 60, part(s, "s")).when(s < 3600, F.concat_ws(" ", part(m, "m"), part(s % 60, "s"))).otherwise(F.concat_ws(" ", part(h, "h"), part(m % 60, "m")))


def bar(value: Column, top: Column, width: int) -> Column:
    """MTH-7: as many marks as the value's share of the width, rounded half up."""
    n = F.when(top > 0, F.floor(value / top * F.lit(float(width)) + F.lit(0.5))).otherwise(F.lit(0.0))
    return F.repeat(F.lit("█"), n.cast("int"))


def hit_rate(read: Column, fresh: Column) -> Column:
    """AGG-3, MTH-5: percent read from the cache, to one decimal, 0 without input."""
    total = read + fresh
    return F.when(total > 0, F.floor(F.lit(1000.0) * read / total + F.lit(0.5)) / F.lit(10.0)).otherwise(F.lit(0.0))


def scrub_tags(c: Column, block_tag: str, id_tag: str) -> Column:
    """STR-1, PRN-15: removes reminder blocks (shortest, over lines), then id tags."""
    blocks = F.regexp_replace(c, F.lit(f"(?s)<{block_tag}[^>]*>.*?</{block_tag}>"), F.lit(""))
    return F.regexp_replace(blocks, F.lit(f"<{id_tag}>[^<]*</{id_tag}>"), F.lit(""))


def glob_regex(pattern: str) -> str:
    """PRD-1: a path glob as a regex for whole strings.  ``**/`` is any number of folders, ``**`` anything, ``*`` and ``?`` stay in a folder."""
    if not pattern:
        return "(?!)"
    out, i, pattern = [], 0, pattern.replace("\\\\", "/")
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        elif pattern[i] == "*":
            out.append("[^/]*")
            i += 1
        elif pattern[i] == "?":
            out.append("[^/]")
            i += 1
        else:
            out.append(re.escape(pattern[i]))
            i += 1
    return rf"\A{''.join(out)}\z"


def path_protected(paths: Column, patterns: list[str]) -> Column:
    """PRD-2: whether any path matches any glob; none of either is false."""
    if not patterns:
        return F.lit(False)
    regex = "|".join(f"(?:{glob_regex(p)})" for p in patterns)
    return F.coalesce(F.exists(paths, lambda p: F.regexp_replace(p, F.lit(r"\\\\"), F.lit("/")).rlike(regex)), F.lit(False))


def tool_protected(tool: Column, patterns: list[str]) -> Column:
    """PRD-3: exact names, and globs among the patterns that hold ``*`` or ``?``."""
    exact, globs = [p for p in patterns if not re.search(r"[*?]", p)], [p for p in patterns if re.search(r"[*?]", p)]
    out = tool.isin(exact) if exact else F.lit(False)
    for g in globs:
        out = out | tool.rlike(glob_regex(g))
    return F.coalesce(out, F.lit(False))


def wildcard_regex(pattern: str) -> str:
    """PRD-8: ``*`` is anything, ``?`` one character, a last `` *`` may be missing; over lines, and for whole strings."""
    pattern = pattern.replace("\\", "/")
    tail = pattern.endswith(" *")
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in (pattern[:-2] if tail else pattern))
    return rf"(?s)\A{body}{'(?: .*)?' if tail else ''}\z"


def file_paths(tool: Column, parameters: Column) -> Column:
    """STR-12: the distinct paths a call names: in a patch text, in nested edits, or as its file path."""
    patch = F.regexp_extract_all(F.get_json_object(parameters, "$.patchText"), F.lit(r"(?m)^\*\*\* (?:Add|Delete|Update) File: (.+)$"), F.lit(1))
    own = F.array(F.get_json_object(parameters, "$.filePath"))
    nested = F.from_json(F.get_json_object(parameters, "$.edits"), "array<struct<filePath:string>>")["filePath"]
    found = F.when(tool == "apply_patch", F.coalesce(patch, F.array().cast("array<string>"))).when(tool == "multiedit", F.concat(own, F.coalesce(nested, F.array().cast("array<string>")))).otherwise(own)
    return F.array_distinct(F.filter(found, lambda p: p.isNotNull() & (p != "")))


def stable_id(prefix: str, seed: Column) -> Column:
    """CMP-22: a prefix and the first 16 hex digits of the seed's SHA-256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(seed, 256), 1, 16))


def signature(tool: Column, parameters: Column) -> Column:
    """PRN-2: the tool and its parameters in canonical form.

    Top-level nulls are dropped, keys are sorted at every level, and a number
    without a fraction is written without one, whatever its form; text that does
    not parse stands for itself.  Without parameters, or with null, false, 0 or
    an empty string, it is the tool alone.
    """
    parsed = F.try_parse_json(parameters)
    kept = F.map_filter(parsed.try_cast("map<string,variant>"), lambda k, v: ~F.is_variant_null(v))
    written = F.regexp_replace(F.coalesce(F.to_json(kept), F.to_json(parsed), parameters), F.lit(r'("(?:[^"\\]|\\.)*")|(-?\d+)\.0(?=[,}\]]|$)'), F.lit("$1$2"))
    return F.when(parameters.isNull() | written.isin("", "null", "false", "0", '""'), tool).otherwise(F.concat(tool, F.lit("::"), written))


def message_ref(n: Column) -> Column:
    """STR-2: m0001 to m9999; null outside."""
    return F.when((n >= 1) & (n <= 9999), F.concat(F.lit("m"), F.lpad(n.cast("string"), 4, "0")))


def block_ref(n: Column) -> Column:
    """STR-2: b1 and up; null below."""
    return F.when(n >= 1, F.concat(F.lit("b"), n.cast("string")))


def ref_tag(ref: Column, id_tag: str) -> Column:
    """STR-2: a reference as a tag."""
    return F.concat(F.lit(f"<{id_tag}>"), ref, F.lit(f"</{id_tag}>"))


def block_marker(n: Column) -> Column:
    """STR-2: how a summary names a block."""
    return F.concat(F.lit("("), block_ref(n), F.lit(")"))


def iso_time(ms: Column) -> Column:
    """Milliseconds since 1970 as ISO text, UTC; null and 0 give null."""
    return F.when(ms != 0, F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss"))
