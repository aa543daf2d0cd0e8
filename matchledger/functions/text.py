"""Normalisers and small parsers as column expressions. Each serves one purpose; they aren't interchangeable."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that say what an organisation is, not which; fixed values.
NOISE = (
    "fotballklubb", "fotballklubben", "ballklubb", "ballklubben", "idrettslag", "idrettslaget", "sportsklubb", "sportsklubben",
    "fotball", "fk", "bk", "il", "ik", "sk", "if", "ff",
)


def _simpler(chars: pd.Series, form: str, is_mark: Callable[[str], bool]) -> pd.Series:
    """For each character that a decomposition without marks changes, the character and what it becomes, as one string."""
    bare = lambda c: "".join(x for x in unicodedata.normalize(form, c) if not is_mark(x))
    return chars.map(lambda s: s if s is None else [c + bare(c) for c in s if bare(c) != c], na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _canonical(chars: pd.Series) -> pd.Series:
    return _simpler(chars, "NFD", lambda c: unicodedata.combining(c) > 0)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _compatible(chars: pd.Series) -> pd.Series:
    return _simpler(chars, "NFKD", lambda c: unicodedata.category(c).startswith("M"))


def _replaced(c: Column, simpler: Callable[[Column], Column]) -> Column:
    """Spark has no normaliser of its own. Without marks each character decomposes by itself, so only the different ones of a text
    go to Python, never the text."""
    chars = F.array_join(F.array_distinct(F.split(F.regexp_replace(c, "[\\x00-\\x7F]+", ""), "")), "")
    return F.aggregate(simpler(chars), c, lambda text, x: F.replace(text, F.substring(x, 1, 1), F.substr(x, F.lit(2))))


def without_marks(c: Column) -> Column:
    """Canonical decomposition without combining marks."""
    return _replaced(c, _canonical)


def slug(c: Column) -> Column:
    """Lower case, the Nordic letters spelled out, other marks dropped, anything else a hyphen."""
    spelled = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), (("æ", "ae"), ("ø", "o"), ("å", "a")), F.lower(c))
    return F.regexp_replace(F.regexp_replace(without_marks(spelled), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def organisation_key(slugged: Column) -> Column:
    """A slug without leading and trailing noise words. Of noise alone the middle word stays (the later of two), as words go one by
    one, first and last in turn."""
    words = "|".join(NOISE)
    parts = F.split(slugged, "-")
    bare = F.regexp_replace(F.regexp_replace(slugged, f"^(?:(?:{words})-)+", ""), f"(?:-(?:{words}))+$", "")
    middle = F.element_at(parts, F.floor(F.size(parts) / 2).cast("int") + 1)
    return F.when(slugged.rlike(f"^(?:{words})(?:-(?:{words}))*$"), middle).otherwise(bare)


#: Letters with a spelled form of their own, before marks are dropped; then pairs of letters that stand for one. Fixed values.
PERSON_LETTERS = (("ø", "o"), ("æ", "a"), ("å", "a"), ("ö", "o"), ("ä", "a"), ("ü", "u"), ("þ", "th"), ("ð", "d"), ("đ", "d"))
PERSON_PAIRS = (("oe", "o"), ("ae", "a"), ("ue", "u"), ("aa", "a"))


def person_key(c: Column) -> Column:
    """Lower case with spellings of one sound joined, marks dropped, words apart by one space."""
    spelled = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), PERSON_LETTERS, F.lower(c))
    joined = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), PERSON_PAIRS, without_marks(spelled))
    return F.trim(F.regexp_replace(joined, "[^a-z0-9]+", " "))


def searchable(c: Column) -> Column:
    """Lower case without marks; letters of their own such as ø stay."""
    return without_marks(F.lower(c))


def words(c: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(c), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


#: Named character references that are common in pages.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def plain_text(html: Column) -> Column:
    """A page without scripts, styles, comments and tags; breaks and block ends become line feeds."""
    bare = F.regexp_replace(html, "(?is)<(script|style)\\b.*?</\\1\\s*>|<!--.*?-->", " ")
    lined = F.regexp_replace(bare, "(?i)<br\\s*/?>|</(p|div|li|tr|h[1-6])\\s*>", "\n")
    text = F.regexp_replace(lined, "<[^>]*>", " ")
    text = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), ENTITIES, text)
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[ \\t\\r]+", " "), " ?\\n[ \\n]*", "\n"))


def links(html: Column) -> Column:
    """Targets of all links of a page, in order."""
    return F.regexp_extract_all(html, F.lit("(?i)<a\\s[^>]*?href=\"([^\"]*)\""), F.lit(1))


def leading_int(c: Column) -> Column:
    """The whole number at the start of a text, else 0."""
    return F.coalesce(F.regexp_extract(c, "^\\s*([+-]?\\d{1,9})", 1).try_cast("int"), F.lit(0))


def redacted(sql: Column) -> Column:
    """A statement with its quoted literals blanked."""
    return F.regexp_replace(sql, "'(?:[^']|'')*'", "'?'")


def stable_hash(*columns: str) -> Column:
    """SHA-256 of named values, the same whatever order the columns are named in; null differs from empty."""
    return F.sha2(F.concat_ws("|", *(F.concat(F.lit(c + "="), F.coalesce(F.concat(F.lit("s:"), F.col(c).cast("string")), F.lit("n"))) for c in sorted(columns))), 256)


def without_compatible_marks(c: Column) -> Column:
    """As ``without_marks``, by compatibility decomposition."""
    return _replaced(c, _compatible)


def compared_name(c: Column, *, markup: bool = True, rings: bool = False, spaces: bool = True) -> Column:
    """A name as it is compared in running text. ``markup``: tags of emphasis count as spaces; ``rings``: å counts as aa (else
    as a); ``spaces``: words stay apart. The variants serve different searches and don't meet."""
    bare = F.regexp_replace(c, "(?i)</?(?:em|strong|b|i)>", " ") if markup else c
    lower = F.replace(F.lower(bare), F.lit("å"), F.lit("aa")) if rings else F.lower(bare)
    return F.trim(F.regexp_replace(without_compatible_marks(lower), "[^a-z0-9æøå]+", " " if spaces else ""))


#: Abbreviations whose full stop ends no sentence. Fixed values.
SHORTENED = ("dr", "st", "jr", "sr", "kl", "ca", "bl", "dvs", "feks", "mfl", "osv", "fk", "aa", "a", "f", "k")
_KEPT_STOP = "\ue000"
#: Where one claim ends and the next begins: lines, sentences, semicolons, words of contrast. Fixed values.
CLAIM_ENDS = "[\\r\\n]+|(?<=[.!?])\\s+(?=[A-ZÆØÅ])|;\\s+|\\s+(?:mens|derimot)\\s+|\\s+i\\s+en\\s+annen\\s+(?:kamp|notis)\\s+"


def claims(c: Column) -> Column:
    """The claims of a text in order, without empty ones."""
    marked = F.regexp_replace(c, f"(?i)(?<![A-Za-z0-9_])({'|'.join(SHORTENED)})\\.", "$1" + _KEPT_STOP)
    parts = F.transform(F.split(marked, CLAIM_ENDS), lambda p: F.regexp_replace(F.replace(p, F.lit(_KEPT_STOP), F.lit(".")), "^\\s+|\\s+$", ""))
    return F.filter(parts, lambda p: p != "")


def parsed_search(c: Column, first: int = 1914, last: int = 2100, most: int = 6) -> Column:
    """What a search asks for: years within bounds, each once, and the other words; ``most`` of each are taken, as the length
    of a search is up to its sender."""
    tokens = F.filter(F.split(F.lower(c), "\\s+"), lambda t: t != "")
    is_year = lambda t: F.when(t.rlike("^[0-9]{4}$"), t.try_cast("int").between(first, last)).otherwise(False)
    years = F.array_distinct(F.transform(F.filter(tokens, is_year), lambda t: t.cast("int")))
    return F.struct(F.slice(years, 1, most).alias("years"), F.slice(F.filter(tokens, lambda t: ~is_year(t)), 1, most).alias("terms"))


def club_key(identity_key: Column, name: Column, ident: Column) -> Column:
    """The key that all spellings of a club share: its own where it has one, else that of its name, of its id, or the id."""
    of = lambda c: F.nullif(organisation_key(slug(c)), F.lit(""))
    return F.coalesce(F.nullif(identity_key, F.lit("")), of(name), of(ident), ident)


def club_forms(ident: Column, name: Column, short: Column, former: Column, variants: Column) -> Column:
    """All spellings that a club is known by, empty ones left out; former and variants are arrays or null."""
    none = F.array().cast("array<string>")
    return F.filter(F.concat(F.array(ident, name, short), F.coalesce(former, none), F.coalesce(variants, none)), lambda x: x.isNotNull() & (x != ""))


def is_encoding_repair(base: Column, head: Column) -> Column:
    """Whether a text differs from its damaged form in nothing but characters where that has replacement characters."""
    same = F.replace(base, F.lit("\ufffd"), F.lit("")) == F.regexp_replace(head, "[^\\x00-\\x7F]", "")
    return F.coalesce(F.contains(base, F.lit("\ufffd")) & same, F.lit(False))


def in_locale(c: Column | str, locale: str = "nb", ignore_case: bool = False) -> Column:
    """A string that sorts, compares and groups by a language's own rules: in nb æ, ø, å and aa come last, in this order. Nulls stay null."""
    return F.collate(c, f"{locale}_CI" if ignore_case else locale)
