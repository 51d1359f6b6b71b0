"""Text measures as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that are no word, number or space; tokens are runs of letters and digits, single CJK characters and single other symbols.
TOKEN = r"[\x{4e00}-\x{9fff}]|[a-zA-Z0-9\x{c0}-\x{24f}]+|[^\sa-zA-Z0-9\x{c0}-\x{24f}\x{4e00}-\x{9fff}]"
UNPRINTABLE = r"[\p{Cc}\p{Cf}\p{Co}\p{Zl}\p{Zp}\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
PLAIN = "[ -~]+"  # of which no character is unprintable
SPACES = r"[ \t\n\x0b\x0c\r]+"
# What RE2 takes as white space and as the edge of a word: ASCII alone.
BLANK, EDGE = r"\t\n\f\r ", "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def re2(pattern: str) -> str:
    """A pattern as RE2 reads it: words end at letters beyond ASCII, lines at \\n only, other case is that of all letters."""
    out, inside = "", False
    words = re.match(r"\\b\((?:\?:)?([0-9A-Za-z_][0-9A-Za-z_ ]*(?:\|[0-9A-Za-z_][0-9A-Za-z_ ]*)*)\)(?![?*{])", pattern)
    if words:  # a word begins where one of their first letters follows on no other: told sooner than the edge
        first = "".join(sorted({w[0] for w in words[1].split("|")}))
        out, pattern = f"(?=[{first}])(?<![0-9A-Za-z_])", pattern[2:]
    for token in re.findall(r"\\.|[^\\]", pattern, re.S):
        inside = (inside or token == "[") and token != "]"
        out += BLANK if token == r"\s" and inside else f"[{BLANK}]" if token == r"\s" else EDGE if token == r"\b" and not inside else token
    return "(?d)" + out.replace("(?i)", "(?iu)")


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, also inside lambdas."""
    return F.transform(F.array(value), use)[0]


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a word."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("long")


def hits(text: Column, words: list[str]) -> Column:
    """How many of the words occur; CJK words are looked for in texts with such a character only."""
    n, cjk = F.lit(0), F.lit(0)
    for w in words:
        found = F.contains(text, F.lit(w)).cast("int")
        if any("\u4e00" <= c <= "\u9fff" for c in w):
            cjk = cjk + found
        else:
            n = n + found
    if all(not "\u4e00" <= c <= "\u9fff" for w in words for c in w):
        return n
    return n + F.when(F.octet_length(text) == F.length(text), F.lit(0)).when(text.rlike(r"[\x{4e00}-\x{9fff}]"), cjk).otherwise(F.lit(0) * F.length(text))


def density(text: Column, words: list[str]) -> Column:
    """20 times the occurrences in 100 characters, at most 100; a word counts once wherever words are listed.

    CJK words are looked for in texts with such a character only, and a word is counted only where it occurs.
    """
    n, cjk = F.lit(0).cast("long"), F.lit(0).cast("long")
    for w in words:
        found = F.when(F.contains(text, F.lit(w)), occurrences(text, w)).otherwise(F.lit(0).cast("long"))
        if any("\u4e00" <= c <= "\u9fff" for c in w):
            cjk = cjk + found
        else:
            n = n + found
    n = n + F.when(text.rlike(r"[\x{4e00}-\x{9fff}]"), cjk).otherwise(F.lit(0).cast("long"))
    return dense(n, F.length(text))


def dense(n: Column, length: Column) -> Column:
    """20 times so many occurrences in 100 characters, at most 100."""
    return F.when(length > 0, F.least(F.lit(100.0), 20.0 * n / (F.greatest(length, F.lit(1)) / 100.0))).otherwise(0.0)


def beyond_ascii(pattern: str) -> bool:
    """Whether all that a pattern matches begins with a character beyond ASCII, as far as its first part tells."""
    part = re.match(r"\[([^\]^]+)\](?![?*{])|\[([^\]^]+)\]\{[1-9]|\(\?:([^()\[\]\\]+)\)(?![?*{])|([^\x00-\x7f])(?![?*{])", pattern)
    if not part or "|" in pattern.replace(part[0], "", 1):
        return False
    if part[3]:
        return all(w[:1] > "\x7f" for w in part[3].split("|"))
    some = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), part[1] or part[2] or part[4])
    return all(c > "\x7f" for c in re.sub("(?<=.)-(?=.)", "", some))


def pattern_share(text: Column, patterns: list[str]) -> Column:
    """Percent of the patterns that match, as RE2 reads them; those that begin beyond ASCII are looked for in such texts only."""
    n, far = F.lit(0), F.lit(0)
    for p in patterns:
        found = F.rlike(text, F.lit(re2(p))).cast("int")
        n, far = (n, far + found) if beyond_ascii(p) else (n + found, far)
    if any(map(beyond_ascii, patterns)):
        n = n + F.when(F.octet_length(text) > F.length(text), far).otherwise(F.lit(0) * F.length(text))
    return 100.0 * n / len(patterns)


def words(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def char_grams(text: Column, n: int, first: int | None = 2000) -> Column:
    """Distinct character n-grams of the first characters, or all, after removal of spaces; shorter texts have none."""
    t = F.replace(text, F.lit(" "), F.lit(""))
    t = t if first is None else F.substring(t, 1, first)
    cut = lambda t: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substr(t, i, F.lit(n))))
    return let(t, lambda t: F.when(F.length(t) >= n, cut(t)).otherwise(F.array().cast("array<string>")))


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union of two arrays of distinct values; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), F.size(a) + F.size(b) - both), F.lit(0.0))


def char_set(text: Column, n: int | None = None) -> Column:
    t = text if n is None else F.substring(text, 1, n)
    return F.when(F.length(t) > 0, F.array_distinct(F.split(t, ""))).otherwise(F.array().cast("array<string>"))


def majority_char(text: Column) -> Column:
    """The character that fills more than half of a text, or any: the middle one in order."""
    chars = F.array_sort(F.split(text, ""))
    return F.element_at(chars, (F.floor(F.size(chars) / 2) + 1).cast("int"))


#: Common characters that are counted one by one; of these and all the rest at most one fills more than half of a text.
COMMON = " eaintsrol"


def may_have_majority(text: Column) -> Column:
    """False only where no character fills more than half of the text: none of the common ones does, nor do all others together."""
    n = F.length(text)
    counts = F.array(*[n - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in COMMON])
    return let(counts, lambda c: F.greatest(F.array_max(c), n - F.aggregate(c, F.lit(0), lambda s, x: s + x)) * 2 > n)
