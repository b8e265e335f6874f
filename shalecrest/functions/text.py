"""Text, path and rank expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4)


def chunk_id(text: Column) -> Column:
    """Equal texts have equal ids: the first 16 hexadecimal digits of their SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def glob_regex(pattern: str, directory: bool = True) -> str:
    """A regular expression for a glob with **, *, ?, [..] and {a,b}; * and ? also match "/".

    With ``directory`` a pattern also matches all that lies below what it names.
    """
    out, level, i = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            while pattern[i : i + 2] == "**":
                i += 1
            if pattern[i + 1 : i + 2] == "/" and pattern[i - 1 : i] == "*":
                out += "(?:.*/)?"
                i += 1
            else:
                out += ".*"
        elif c == "?":
            out += "."
        elif c == "{":
            out, level = out + "(?:", level + 1
        elif c == "}" and level:
            out, level = out + ")", level - 1
        elif c == "," and level:
            out += "|"
        elif c == "[" and "]" in pattern[i + 2 :]:
            j = pattern.index("]", i + 2)
            body = pattern[i + 1 : j].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = j
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}(?:/.*)?$" if directory else f"^{out}$"


TAG = re.compile(r"[a-z0-9][a-z0-9\-_:]{0,63}")


def checked_tags(tags: list[str]) -> list[str]:
    """The tags, if all of them are valid."""
    for t in tags:
        if not TAG.fullmatch(t):
            raise ValueError(f"invalid tag {t!r}")
    return tags


def nearest_rank(values: Column, p: float) -> Column:
    """Of a sorted array the element at floor(p n), at most the last; null if it is empty. No interpolation."""
    return F.when(F.size(values) > 0, F.get(values, F.least(F.floor(F.lit(p) * F.size(values)), F.size(values) - 1).cast("int")))


def extension(path: Column) -> Column:
    """What follows the last dot of a path's last part, in lower case; empty without one."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(slashed(path), "/"), -1)


def dirname(path: Column) -> Column:
    """All before the last slash; empty without one."""
    return F.regexp_extract(slashed(path), r"^(.*)/[^/]*$", 1)


def slashed(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def sentences(text: Column) -> Column:
    """Trimmed pieces that end with a full stop, exclamation or question mark, or a line; those of up to ten bytes are left out."""
    parts = F.transform(F.split(text, r"(?<=[.!?\n])", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda x: F.octet_length(x) > 10)


def token_set(text: Column, least: int = 3) -> Column:
    """The distinct words between white space, in lower case, of ``least`` characters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda x: F.length(x) >= least))


def jaccard(a: Column, b: Column) -> Column:
    """The share that two sets have in common of what either has; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(0.0)).otherwise(both / union)


def shortened(text: Column, most: int) -> Column:
    """The first ``most`` characters with a note of how many there are; a text that isn't longer stays."""
    n = F.length(text)
    return F.when(n <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("… ("), n.cast("string"), F.lit(" characters in all)")))


def djb2(text: Column) -> Column:
    """The 32-bit djb2 hash with exclusive or, of UTF-16 units below 65,536, as base 36 in lower case."""
    h = F.aggregate(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c)), F.lit(5381).cast("long"), lambda s, x: ((s * 33) % F.lit(1 << 32)).bitwiseXOR(x.cast("long")))
    return F.lower(F.conv(h.cast("string"), 10, 36))


def toon_cell(text: Column) -> Column:
    """A cell of a TOON table: quoted where it would not be read as this string otherwise."""
    odd = (text == "") | text.rlike(r"[,\"\n]|^\s|\s$") | text.isin("true", "false", "null") | text.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$") | text.rlike(r"(?i)^[+-]?(?:inf|infinity|nan)$")
    return F.when(odd, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(logits: Column, at: int) -> Column:
    """The share of one of the logits of an array."""
    top = F.array_max(logits)
    return F.exp(F.element_at(logits, at + 1) - top) / F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))


def retryable(message: Column) -> Column:
    """Whether what an error says is worth another try: not if access is denied or a thing isn't there, nor on a status 4xx but 429."""
    status = F.regexp_extract(message, r"\b(4[0-9]{2})\b", 1)
    return ~F.lower(message).rlike("access denied|forbidden|unauthorized|not found") & ((status == "") | (status == "429"))
