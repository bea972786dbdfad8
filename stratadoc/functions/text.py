"""Scalar text functions as Column expressions: whatever they do stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns and limits that results must agree on.
PUNCTUATION = r"[\s\p{Z}|*`（）()，。、：；「」【】\[\]{}<>~]+"
IDENTIFIER = r"`([^`]+)`|[A-Za-z_][A-Za-z0-9_]+|\p{Nd}+"
REFUSAL = "资料里没有提到|资料中没有提到|资料里没有|未提到|没有相关"
REFUSAL_CHARS = 40
CODE_SEGMENT = r"`[^`]+`|[^`]+|`"
CODE_SPLIT = r"[^A-Za-z0-9_]+"
WORD = r"[A-Za-z_][A-Za-z0-9_]*(?::[A-Za-z0-9_]+)+|[\p{L}\p{N}_&&[^\p{IsHan}]]+|\p{IsHan}+"
PLAIN_WORD = r"[A-Za-z_][A-Za-z0-9_]*(?::[A-Za-z0-9_]+)+|[\p{L}\p{N}_]*[\p{L}\p{N}][\p{L}\p{N}_]*"
NOT_PLAIN = r"[`\p{IsHan}]|_:"
ANCHOR_CHARS = 60
FUZZY_CHARS = 8
GRAM = 3
FENCES = ("```", "~~~")


def strip_left(text: Column) -> Column:
    """Without leading white space of any kind."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+", "")


def norm(text: Column) -> Column:
    """Without white space and the listed punctuation."""
    return F.regexp_replace(text, PUNCTUATION, "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, also where body uses it for each element of an array."""
    return F.get(F.transform(F.array(value), body), 0)


def char_ngrams(text: Column, n: int = GRAM) -> Column:
    """Runs of n characters of norm(text), repeats included; the whole of it when it is shorter, none when it is empty."""

    def grams(chars: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(chars) - n, F.lit(0)))
        return F.transform(starts, lambda i: F.concat(*(F.coalesce(F.get(chars, i + j), F.lit("")) for j in range(n))))

    none = F.expr("cast(array() as array<string>)")
    return let(norm(text), lambda s: F.when(s == "", none).otherwise(let(F.split(s, ""), grams)))


def identifiers(text: Column) -> Column:
    """Code spans, names of two characters or more, and numbers of two to six digits; each once, in order."""
    whole = F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))
    bare = F.transform(whole, lambda t: F.trim(F.regexp_replace(t, "^`|`$", "")))
    keep = lambda t: (F.length(t) >= 2) & ~(t.rlike(r"^\p{Nd}+$") & (F.length(t) > 6))
    return F.array_distinct(F.filter(bare, keep))


def is_refusal(text: Column) -> Column:
    """A phrase of refusal in an answer that holds little else."""
    return text.rlike(REFUSAL) & (F.length(norm(text)) <= REFUSAL_CHARS)


def anchor_of(text: Column) -> Column:
    """The start of a block by which it is found again in its document."""
    return F.substring(strip_left(text), 1, ANCHOR_CHARS)


def _bigrams(token: Column) -> Column:
    """A run of Han characters as overlapping pairs: a stand-in for a segmenter, which this package has none of."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(token) - 1, F.lit(1))), lambda i: F.substring(token, i, F.lit(2)))
    return F.when(token.rlike(r"^\p{IsHan}"), pairs).otherwise(F.array(token))


def tokenize(text: Column, segment: Callable[[Column], Column] | None = None, strict_code: bool = False) -> Column:
    """Lower-case index terms, repeats included: in code spans split at all but ASCII word characters, elsewhere whole names.

    segment: what makes an array of terms of a word outside code, runs of Han characters among them (a Column function,
    or a pandas UDF that calls a segmenter); overlapping pairs where it isn't given. strict_code takes the marks of fences
    out first, so that they aren't paired with those of code spans.
    """
    segment = segment or _bigrams
    if strict_code:
        text = F.regexp_replace(text, r"(?m)^[ \t]*(?:```|~~~).*$", "")
    segments = F.regexp_extract_all(text, F.lit(CODE_SEGMENT), F.lit(0))
    prose = lambda s: F.flatten(F.transform(F.regexp_extract_all(s, F.lit(WORD), F.lit(0)), segment))
    is_code = lambda s: F.startswith(s, F.lit("`")) & (F.length(s) > 2)
    terms = F.flatten(F.transform(segments, lambda s: F.when(is_code(s), F.split(s, CODE_SPLIT)).otherwise(prose(s))))
    marked = F.filter(F.transform(terms, F.lower), lambda t: t.rlike(r"[\p{L}\p{N}]"))
    # Most texts hold neither code nor Han: one pass finds their terms.
    plain = F.transform(F.regexp_extract_all(text, F.lit(PLAIN_WORD), F.lit(0)), F.lower)
    return F.when(text.rlike(NOT_PLAIN), marked).otherwise(plain)


def fuzzy_in(needle: Column, hay: Column, mode: str = "compat") -> Column:
    """Whether needle occurs in hay up to one edit. Needles under FUZZY_CHARS characters must occur as they are.

    compat allows for one character of the needle to be missing or another; edit1 also for one more. A half of the
    needle occurs as it is in every case, which spares most pairs the search.
    """
    if mode not in ("compat", "edit1"):
        raise ValueError(mode)

    def search(a: Column, h: Column) -> Column:
        n = F.length(a)
        half = F.floor(n / 2).cast("int")
        sieve = F.contains(h, F.substring(a, F.lit(1), half)) | F.contains(h, F.substring(a, half + 1, n))
        cut = lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, n))
        near = F.exists(F.sequence(F.lit(1), n), lambda i: F.contains(h, cut(i)))

        def other(chars: Column, text: Column) -> Column:
            differ = lambda s: F.size(F.filter(F.sequence(F.lit(0), F.size(chars) - 1), lambda i: F.get(chars, i) != F.get(text, s + i)))
            return F.exists(F.sequence(F.lit(0), F.size(text) - F.size(chars)), lambda s: differ(s) <= 1)

        near = near | ((F.length(h) >= n) & let(F.struct(F.split(a, "").alias("a"), F.split(h, "").alias("h")), lambda p: other(p["a"], p["h"])))
        if mode == "edit1":
            quoted = lambda i: F.concat(F.lit(r"(?s)\Q"), F.substring(a, F.lit(1), i), F.lit(r"\E.\Q"), F.substring(a, i + 1, n), F.lit(r"\E"))
            near = near | F.exists(F.sequence(F.lit(1), n - 1), lambda i: F.regexp_count(h, quoted(i)) > 0)
        return F.when(F.contains(h, a), True).when((n >= FUZZY_CHARS) & sieve, near).otherwise(False)

    return let(F.struct(needle.alias("needle"), hay.alias("hay")), lambda p: search(p["needle"], p["hay"]))


def is_fence(line: Column) -> Column:
    bare = strip_left(line)
    return F.startswith(bare, F.lit(FENCES[0])) | F.startswith(bare, F.lit(FENCES[1]))


def lone_fences(text: Column) -> Column:
    """Number of fence lines: odd when a fence is torn."""
    return F.size(F.filter(F.split(text, "\n", -1), is_fence)).cast("long")


def heading_path(path: Column) -> Column:
    """Titles of a map from level to title, by level."""
    return F.array_join(F.transform(F.array_sort(F.map_keys(path)), lambda k: path[k]), " > ")


def render(text: Column, path: Column, inject: bool = True) -> Column:
    """A block as it is indexed: its headings before it."""
    heading = heading_path(path)
    return F.when(F.lit(inject) & (heading != ""), F.concat(F.lit("[章节] "), heading, F.lit("\n"), text)).otherwise(text)


def preview(text: Column, chars: int = 56) -> Column:
    """The first characters of a text on one line, line ends shown, and an ellipsis; null for null."""
    return F.concat(F.replace(F.substring(text, 1, chars), F.lit("\n"), F.lit("⏎")), F.lit("…"))
