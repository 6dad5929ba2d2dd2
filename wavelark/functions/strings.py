"""Text, URL and token functions as column expressions."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@pandas_udf(StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    """All named and numeric entities."""
    return s.map(lambda x: None if x is None else html.unescape(x))


@pandas_udf(StringType())
def strip_accents(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def basic_unescape(c: Column) -> Column:
    """The five entities of XML, inside the JVM."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def text_clean(c: Column, entities: bool = True) -> Column:
    """Null for 'null'; entities decoded; runs of white space and NUL are one space."""
    c = F.nullif(c, F.lit("null"))
    return F.regexp_replace(html_unescape(c) if entities else basic_unescape(c), r"[\s\x00]+", " ")


def url_decode(c: Column) -> Column:
    """Percent-decoded, with '_' as space and '+' kept; what can't be decoded stays as it is."""
    return F.replace(F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c), F.lit("_"), F.lit(" "))


def url_encode(c: Column) -> Column:
    """Decoded, spaces as '_', then percent-encoded except letters, digits and ``-._~/``."""
    c = F.url_encode(F.replace(url_decode(c), F.lit(" "), F.lit("_")))
    for a, b in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def name_canonical(c: Column) -> Column:
    """``project+article$norm`` with the article in canonical URL form; prefix and suffix are optional."""
    prefix = F.regexp_extract(c, r"^([^+]+\+)?", 1)
    middle = F.regexp_extract(c, r"^(?:[^+]+\+)?(.*?)(?:\$norm)?$", 1)
    return F.concat(prefix, url_encode(middle), F.regexp_extract(c, r"(\$norm)?$", 1))


def norm_suffix(c: Column) -> Column:
    return F.concat(c, F.lit("$norm"))


def project_of(c: Column) -> Column:
    return F.split(c, r"\+", 2)[0]


def article_of(c: Column) -> Column:
    return F.get(F.split(c, r"\+", 2), F.lit(1))


def project_domain(c: Column) -> Column:
    """A page-view project code's wiki domain (``en`` -> en.wikipedia.org, ``de.d`` -> de.wiktionary.org)."""
    kinds = {"b": "wikibooks", "d": "wiktionary", "n": "wikinews", "q": "wikiquote", "s": "wikisource", "v": "wikiversity"}
    table = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    part = F.split(c, r"\.")
    return F.concat(part[0], F.lit("."), F.coalesce(F.try_element_at(table, F.get(part, F.lit(1))), F.lit("wikipedia")), F.lit(".org"))


def to_query(c: Column, accents: bool = True, phrases: list[str] | None = None) -> Column:
    """A search query from an article name: no parenthesis, accents or marks, in lower case, without the ``phrases``."""
    c = F.regexp_replace(url_decode(c), r"\s*\([^)]*\)", "")
    c = F.lower(strip_accents(c) if accents else c)
    c = F.regexp_replace(c, r"[^a-z0-9' -]", "")
    for p in phrases or []:
        c = F.replace(c, F.lit(p), F.lit(""))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def alias(c: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(c, r"[^0-9A-Za-z]+", "")


def tokens_space(c: Column) -> Column:
    """Lower-case tokens between white space; an empty array for null or blank text."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda t: t != "")


#: Scripts in Unicode's names but those that are written without spaces between words (Thai, Lao, Khmer, Myanmar) and what several scripts share.
_SCRIPTS = """Latin Greek Cyrillic Arabic Hebrew Armenian Georgian Devanagari Bengali Tamil Telugu Hangul Han Hiragana Katakana Ethiopic Gurmukhi Gujarati Oriya Kannada Malayalam
Sinhala Tibetan Cherokee Canadian_Aboriginal Ogham Runic Tagalog Hanunoo Buhid Tagbanwa Mongolian Limbu Tai_Le New_Tai_Lue Buginese Tai_Tham Balinese Sundanese Batak Lepcha
Ol_Chiki Glagolitic Coptic Tifinagh Bopomofo Yi Lisu Vai Bamum Syloti_Nagri Phags_Pa Saurashtra Kayah_Li Rejang Javanese Cham Tai_Viet Meetei_Mayek Syriac Thaana Nko Samaritan
Mandaic Gothic Old_Italic Deseret Shavian Osmanya Cypriot Linear_B""".split()


def runs_script(c: Column) -> Column:
    """Runs of letters of one script as they stand; scripts written without spaces (Thai, Lao, Khmer, Myanmar), and common signs, are left out.

    Each run is one class of characters, common letters first, and what is no letter is passed over before any script is tried.
    """
    pattern = "|".join(rf"[{'a-zA-Z' if s == 'Latin' else ''}[\p{{Is{s}}}&&\p{{L}}]]++" for s in _SCRIPTS)
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"((?=\p{{L}})(?:{pattern}))"), F.lit(1))


def tokens_script(c: Column) -> Column:
    """Runs of letters of one script in lower case (see ``runs_script``)."""
    return F.transform(runs_script(c), F.lower)


def script_of(c: Column) -> Column:
    """The script of a letter (or of the first letter of several of one script); 'Common' for other characters."""
    out = F.when(c.rlike(r"\p{IsLatin}"), "Latin")
    for s in _SCRIPTS[1:]:
        out = out.when(c.rlike(rf"\p{{Is{s}}}"), s)
    return out.otherwise("Common")


def field_tokens(fields: dict[str, Column], unify: bool = False) -> Column:
    """Tokens of several fields, each with its field's code ahead unless they are unified."""

    def of(k: str, c: Column) -> Column:
        return tokens_space(c) if unify else F.transform(tokens_space(c), lambda t: F.concat(F.lit(k + " "), t))

    return F.concat(*[of(k, c) for k, c in fields.items()])


def int_or_float(c: Column) -> tuple[Column, Column]:
    """A text as a whole number and as a real one; null where it isn't."""
    return F.when(c.rlike(r"^\s*[-+]?[0-9]+\s*$"), c.try_cast("long")), c.try_cast("double")


def si_text(c: Column) -> Column:
    """A number with a decimal prefix."""
    return F.when(c < 1000, c.cast("long").cast("string")).when(c < 1000000, F.format_string("%.1fk", c / 1000)).otherwise(F.format_string("%.1fM", c / 1000000))


def sparse_text(c: Column) -> Column:
    """The values of an array but zeros, as ``place:value`` parted by spaces."""
    rows = F.transform(c, lambda v, i: F.when(v != 0, F.concat(i.cast("string"), F.lit(":"), v.cast("string"))))
    return F.concat_ws(" ", F.filter(rows, lambda x: x.isNotNull()))


@pandas_udf(StringType())
def _g4(s: pd.Series) -> pd.Series:
    return s.map(lambda x: "" if pd.isna(x) else f"{x:.4g}")


def g4_text(c: Column) -> Column:
    """Four significant digits as C has them for ``%.4g``; null and NaN as nothing. In Python, as Java rounds the shortest decimal of a number and C the number itself."""
    return _g4(c.cast("double"))


def without_common_prefix(names: list[str]) -> list[str]:
    """The names without what all of them begin with."""
    import os.path

    return [n[len(os.path.commonprefix(names)) :] for n in names]


def partition_sentinel(items: list, sentinel) -> tuple[list, list]:
    """What is before the first ``sentinel`` and what is after it."""
    at = items.index(sentinel) if sentinel in items else len(items)
    return items[:at], items[at + 1 :]


def slices(text: str, place: Column, total: Column) -> Column:
    """Whether a place (from 0) of ``total`` is in one of the slices of a text such as ``0,2:4,-2:``."""
    out = F.lit(False)
    for part in text.split(","):
        if ":" not in part:
            i = int(part)
            out = out | (place == (i if i >= 0 else total + i))
            continue
        bounds = part.split(":")
        lo, hi = (int(b) if b else None for b in bounds[:2])
        step = int(bounds[2]) if len(bounds) > 2 and bounds[2] else 1
        if step < 1:
            raise ValueError("steps go forward")
        first = F.lit(0) if lo is None else F.lit(lo) if lo >= 0 else F.greatest(total + lo, F.lit(0))
        last = total if hi is None else F.lit(hi) if hi >= 0 else total + hi
        out = out | ((place >= first) & (place < last) & ((place - first) % step == 0))
    return out


def tokens_word(c: Column) -> Column:
    """Words of letters and digits, with inner apostrophes and hyphens, in lower case."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"([\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*)"), F.lit(1)), F.lower)


def is_latin(c: Column) -> Column:
    return c.rlike(r"^[\x00-\xFF]*$")


def is_japanese(c: Column) -> Column:
    return c.rlike(r"[一-龿぀-ヿ]")


def tokens_routed(c: Column) -> Column:
    """Latin tokens by word rules, Japanese ones by runs of one script, others dropped."""
    def route(t: Column) -> Column:
        return F.when(is_latin(t), tokens_word(t)).when(is_japanese(t), tokens_script(t)).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(tokens_space(c), route))


def ngrams(tokens: Column, n: int) -> Column:
    """All 1-grams, then 2-grams and so on up to n, joined by spaces."""
    if n < 1:
        raise ValueError("n must be at least 1")
    none = F.array().cast("array<string>")
    size = F.size(tokens)
    out = []
    for k in range(1, n + 1):
        out.append(F.when(size >= k, _joined(tokens, size, k)).otherwise(none))
    return F.concat(*out)


def _joined(tokens: Column, size: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(size - (k - 1), F.lit(1))), lambda i: F.concat_ws(" ", F.slice(tokens, i, F.lit(k))))


def without_ext(c: Column, ext: str | None = None) -> Column:
    return F.regexp_replace(c, (ext.replace(".", r"\.") + "$") if ext else r"\.[^./]*$", "")


def options(c: Column) -> Column:
    """A map from ``a=1,b=2``."""
    return F.str_to_map(c, F.lit(","), F.lit("="))


def keyword(c: Column) -> Column:
    """A keyword line without its comment, in lower case; null if nothing is left."""
    return F.nullif(F.lower(F.trim(F.regexp_replace(c, "#.*$", ""))), F.lit(""))


def bytes_text(c: Column) -> Column:
    """A size with a binary prefix."""
    return F.when(c < 1024, F.format_string("%d B", c.cast("long"))).when(c < 1048576, F.format_string("%.1f KiB", c / 1024)).otherwise(F.format_string("%.1f MiB", c / 1048576))


def seconds_text(c: Column) -> Column:
    """h:mm:ss."""
    s = c.cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def merge_maps(a: Column, b: Column) -> Column:
    """A map of arrays with the keys of both, arrays of one key appended."""
    none = F.create_map().cast("map<string,array<bigint>>")
    empty = F.array().cast("array<bigint>")
    return F.map_zip_with(F.coalesce(a, none), F.coalesce(b, none), lambda _, x, y: F.concat(F.coalesce(x, empty), F.coalesce(y, empty)))


def merge_dicts(a: dict, b: dict) -> dict:
    """Two nested dictionaries as one: lists are appended, equal values kept, others in conflict."""
    out = dict(a)
    for k, v in b.items():
        if k not in out:
            out[k] = v
        elif isinstance(v, dict) and isinstance(out[k], dict):
            out[k] = merge_dicts(out[k], v)
        elif isinstance(v, list) and isinstance(out[k], list):
            out[k] = out[k] + v
        elif out[k] != v:
            raise ValueError(f"conflict at {k!r}")
    return out
