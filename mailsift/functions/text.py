"""Text expressions. Lengths count characters; character classes are Unicode-aware.

Counts of single characters compare lengths before and after removal, which needs no array of
matches; long bodies stay cheap.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# White space as Unicode-aware text tools see it. In Unicode mode the space class covers all of it
# but four control characters; this form is several times faster than listing the ranges.
SPACE = r"\s\x1c-\x1f"
SPACE_CHARS = "".join(chr(c) for c in (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def filled(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def left_after(c: Column, pattern: str) -> Column:
    """Number of characters left when every match of ``pattern`` is removed."""
    return F.length(F.regexp_replace(c, pattern, ""))


def removed_by(c: Column, pattern: str) -> Column:
    return F.length(c) - left_after(c, pattern)


def count_char(c: Column, ch: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def num_special(c: Column, keep_all_space: bool = False) -> Column:
    """Characters that are neither ASCII letters, digits nor space (batch: blank only)."""
    return left_after(c, f"(?U)[a-zA-Z0-9{SPACE}]+" if keep_all_space else "[a-zA-Z0-9 ]+")


def num_digits(c: Column) -> Column:
    return removed_by(c, r"\p{Nd}+")


def num_caps(c: Column) -> Column:
    return removed_by(c, r"\p{IsUppercase}+")


def percent_caps(c: Column) -> Column:
    return num_caps(c) / F.greatest(F.length(c), F.lit(1))


def word_count(c: Column) -> Column:
    """Runs of non-space characters: each becomes one mark, the rest goes, the marks are counted."""
    return F.length(F.regexp_replace(F.regexp_replace(c, f"(?U)[^{SPACE}]+", "w"), "[^w]+", ""))


def squeezed_word_count(c: Column) -> Column:
    """Words of a text that is trimmed and holds single blanks only."""
    return F.when(c == "", 0).otherwise(count_char(c, " ") + 1)


def upper_words(c: Column) -> Column:
    """Words with at least one capital and no small or title-case letter."""
    def shouting(w: Column) -> Column:
        return w.rlike(r"\p{IsUppercase}") & ~w.rlike(r"[\p{IsLowercase}\p{Lt}]")
    return F.size(F.filter(F.split(c, f"(?U)[{SPACE}]+"), shouting))


def has_reply_mark(c: Column) -> Column:
    """``re`` or ``fwd`` as a word of its own, in any case."""
    return c.rlike(r"(?i)(^|[^\p{L}\p{N}_])(re|fwd)($|[^\p{L}\p{N}_])").cast("int")


def contains_html(c: Column) -> Column:
    return c.rlike("<[^>]+>").cast("int")


def strip(c: Column) -> Column:
    """Looks at both ends only, whatever the length of the text."""
    return F.trim(c, F.lit(SPACE_CHARS))


LINK = f"(?U)http[^{SPACE}]+"
# a word with an inner @; tried at word starts only, without backtracking
ADDRESS = f"(?U)(?<![^{SPACE}])[^{SPACE}][^{SPACE}@]*+@[^{SPACE}]+"


def mark_links(c: Column) -> Column:
    """Links of a lower-case text become a word; a text that cannot hold one is not searched."""
    return F.when(F.contains(c, F.lit("http")), F.regexp_replace(c, LINK, " link ")).otherwise(c)


def mark_addresses(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("@")), F.regexp_replace(c, ADDRESS, " email ")).otherwise(c)


def plain_word_count(c: Column) -> Column:
    """Words that :func:`clean` would leave of a text whose links and addresses are marked."""
    return F.regexp_count(c, F.lit("[a-z0-9]+"))


def clean(c: Column, mode: str = "batch") -> Column:
    """Lower-case words. ``batch`` marks links and addresses; ``alpha`` drops tags, links and digits."""
    t = F.lower(filled(c))
    if mode == "batch":
        t = F.regexp_replace(F.regexp_replace(t, LINK, " link "), ADDRESS, " email ")
        letters = "a-z0-9"
    elif mode == "alpha":
        t = F.regexp_replace(t, "<[^\n]*?>", "")
        t = F.regexp_replace(t, f"(?U)http[^{SPACE}]+|www[^{SPACE}]+", "")
        t = F.regexp_replace(t, "^(re|fwd):", "")
        letters = "a-z"
    else:
        raise ValueError(f"unknown mode {mode!r}")
    # other characters become blanks and blanks are squeezed: one step
    return F.trim(F.regexp_replace(t, f"[^{letters}]+", " "))
