"""Company names: normal forms, descriptors, tokens and how alike two names are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that names end in without being told apart by them, for the three kinds of normal form.
LEGAL_SUFFIXES = ("INCORPORATED", "INCORPORATION", "CORPORATION", "COMPANY", "LIMITED", "HOLDINGS", "HOLDING", "GROUP", "TRUST", "PARTNERS", "PARTNERSHIP", "INC", "CORP", "CO", "LTD", "LLC", "LP", "LLP", "PLC", "SA", "NV", "AG", "PUBLIC")
ISSUER_SUFFIXES = ("INC", "CORP", "CORPORATION", "CO", "COMPANY", "LTD", "LLC", "LP", "LLP", "PLC", "HOLDINGS", "HOLDING", "GROUP", "NV", "SE", "AG")
ISSUER_STOPWORDS = ("INC", "CORP", "CORPORATION", "CO", "COMPANY", "LTD", "LIMITED", "PLC", "HOLDINGS", "HOLDING", "GROUP", "THE", "CLASS", "COMMON", "STOCK")
# Endings that security listings add to an issuer's name, in the order in which they are taken off.
DESCRIPTORS = (
    r"-CW\d+$",
    r"-SPON ADR$",
    r"-SPONS\s?ADR$",
    r"[-\s]*SPONSORED\s+ADR$",
    r"[-\s]+ADR$",
    r"[-\s]*W/I$",
    r"\s*-\s*CL\s[A-Z]$",
    r"\s*-\s*CLASS\s[A-Z]$",
    r"-NEW$",
    r"-WI$",
    r"-WTS?$",
    r"-RTS$",
    r"-UNITS?$",
    r"\s*-\s*[A-Z]$",
)

# Abbreviations that are no prefix of what they stand for.
EXPANSIONS = (("COS", "COMPANIES"), ("HLDGS", "HOLDINGS"), ("INTL", "INTERNATIONAL"))


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, " +", " "))


def _without_last(text: Column, words: tuple[str, ...]) -> Column:
    return F.trim(F.regexp_replace(text, rf"(?:(?:^| )(?:{'|'.join(words)}))+$", ""))


def normal_name(name: Column) -> Column:
    """Upper case without jurisdiction tag, punctuation, AND and trailing legal words; empty for null."""
    text = F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), r"[/\\]\s*[A-Z]+\s*[/\\]?$", "")
    # a run of single letters with full stops is one word: mark its stops, then drop them
    text = F.regexp_replace(text, r"(?<=\b[A-Z])\.(?=[A-Z]\.)|(?<=\.[A-Z])\.", "")
    text = F.regexp_replace(text, r"'(?=S(?:[^A-Za-z0-9]|$))", "")
    text = F.regexp_replace(text, r"[^A-Z0-9 ]+", " ")
    text = F.regexp_replace(text, r"(?<= |^)AND(?= |$)", " ")
    return _without_last(_squeezed(text), LEGAL_SUFFIXES)


def normal_issuer(name: Column) -> Column:
    """Upper case without a leading THE, a trailing article tag, punctuation and trailing suffixes."""
    text = F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), r"/(THE|A|AN)$", "")
    text = F.regexp_replace(_squeezed(F.regexp_replace(text, r"[^A-Z0-9 ]", " ")), r"^THE(?: |$)", "")
    return _without_last(text, ISSUER_SUFFIXES)


def without_descriptors(name: Column) -> Column:
    out = F.coalesce(name, F.lit(""))
    for pattern in DESCRIPTORS:
        out = F.regexp_replace(out, f"(?i){pattern}", "")
    return out


def issuer_tokens(name: Column) -> Column:
    """Distinct words of a name but for stop words, sorted."""
    words = F.regexp_extract_all(F.upper(F.coalesce(name, F.lit(""))), F.lit("[A-Z0-9]+"), F.lit(0))
    return F.array_sort(F.array_except(words, F.array(*map(F.lit, ISSUER_STOPWORDS))))


def long_tokens(name: Column) -> Column:
    """Words of three letters or more but for stop words."""
    return F.filter(issuer_tokens(name), lambda w: F.length(w) >= 3)


def issuer_score(a: Column, b: Column) -> Column:
    """1 for the same words, 0.6 for half of them in common, 0 for less, 0.3 where a name says nothing."""
    x, y = issuer_tokens(a), issuer_tokens(b)
    half = 2 * F.size(F.array_intersect(x, y)) >= F.size(F.array_union(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.3).when(x == y, 1.0).when(half, 0.6).otherwise(0.0)


def id_score(a: Column, b: Column) -> Column:
    known = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return F.when(~known, 0.3).when(a == b, 1.0).otherwise(0.0)


def volume_score(a: Column, b: Column) -> Column:
    both = (a > 0) & (b > 0)
    return F.when(F.coalesce(both, F.lit(False)), F.round(F.least(a, b) / F.greatest(a, b), 4)).otherwise(0.25)


def cut_related(a: Column, b: Column) -> Column:
    """Whether two token arrays of one length, two tokens at least, differ by a cut in the last token only.

    What is left of it has three letters or more, and what is cut off is not a Roman numeral.
    """
    n = F.size(a)
    x, y = F.try_element_at(a, n), F.try_element_at(b, n)
    short, long = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    rest = F.substring(long, F.length(short) + 1, F.length(long))
    but_last = F.slice(a, 1, F.greatest(n - 1, F.lit(0))) == F.slice(b, 1, F.greatest(n - 1, F.lit(0)))
    return (n >= 2) & (n == F.size(b)) & but_last & (F.length(short) >= 3) & F.startswith(long, short) & rest.rlike("[^IVXLCDM]")


def prefix_related(a: Column, b: Column) -> Column:
    """Whether the shorter of two token arrays, of two tokens at least, is a prefix of the longer, or they are ``cut_related``."""
    n = F.least(F.size(a), F.size(b))
    return ((n >= 2) & (F.slice(a, 1, n) == F.slice(b, 1, n))) | cut_related(a, b)


def _expanded(words: Column) -> Column:
    out = words
    for short, long in EXPANSIONS:
        out = F.transform(out, lambda w: F.when(F.upper(w) == short, F.lit(long)).otherwise(w))
    return out


def query_variants(name: Column) -> Column:
    """Searches for a company, the most specific first, each once whatever its case.

    The name, the name without descriptors, and that with ever fewer words down to one; each is
    followed by itself with abbreviations written out, where it has any.
    """
    words = lambda x: F.filter(F.split(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " ")), " "), lambda w: w != "")
    bare = words(without_descriptors(name))
    shorter = F.transform(F.sequence(F.lit(0), F.greatest(F.size(bare) - 1, F.lit(0))), lambda k: F.slice(bare, 1, F.greatest(F.size(bare) - k, F.lit(0))))
    every = F.concat(F.array(words(name)), shorter)
    both = F.flatten(F.transform(every, lambda w: F.array(F.array_join(w, " "), F.array_join(_expanded(w), " "))))
    lower = F.transform(both, lambda x: F.lower(x))
    return F.filter(both, lambda x, i: (x != "") & (F.array_position(lower, F.lower(x)) == i + 1))


def same_company(issuer: Column, candidate: Column, broad: bool = False) -> Column:
    """Whether a candidate's name is the issuer's: as it stands, without descriptors, written out, or cut in its last word.

    ``broad``: or one is a prefix of the other; for candidates that a symbol has singled out.
    """
    target, bare = normal_name(candidate), normal_name(without_descriptors(issuer))
    written_out = normal_name(F.array_join(_expanded(F.split(bare, " ")), " "))
    alike = prefix_related if broad else cut_related
    same = (normal_name(issuer) == target) | (bare == target) | (written_out == target) | alike(F.split(bare, " "), F.split(target, " "))
    return F.coalesce((target != "") & same, F.lit(False))


def symbol_key(symbol: Column) -> Column:
    return F.regexp_replace(F.upper(symbol), "[^A-Z0-9]", "")


def archive_cik(url: Column) -> Column:
    """Registrant number in an archive address, without leading zeros."""
    return F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), r"/data/0*([1-9][0-9]*)/", 1), F.lit(""))


def loose_date(text: Column) -> Column:
    """Date written as ISO, with slashes, in eight digits or with a month's name; null for others."""
    tidy = F.regexp_replace(F.trim(text), r"\s+", " ")
    forms = (("yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$"), ("yyyyMMdd", r"^\d{8}$"), ("MM/dd/yyyy", r"^\d{2}/\d{2}/\d{4}$"), ("MMMM d, yyyy", r"^[A-Z][a-z]+ \d{1,2}, \d{4}$"))
    return F.coalesce(*[F.when(tidy.rlike(shape), F.try_to_date(tidy, form)) for form, shape in forms])


def names_symbol(text: Column, symbol: Column) -> Column:
    """Whether a text holds a symbol as a word of its own."""
    return F.concat(F.lit(" "), F.regexp_replace(F.upper(text), "[^A-Z0-9]+", " "), F.lit(" ")).contains(F.concat(F.lit(" "), F.upper(symbol), F.lit(" ")))


def html_text(html: Column) -> Column:
    """A page's text: without scripts, styles and tags, entities read, space squeezed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"\s+", " "))
