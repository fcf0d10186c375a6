"""Names: normalisation, similarity, tokens, and the predicates on them, as Column expressions."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinweave.functions.text import let, strip

# Honorifics that normalisation drops.
TITLES = ("mr", "mrs", "ms", "dr", "prof", "sir", "dame", "lord", "lady", "rev", "gen", "col", "capt", "sgt", "cpl", "pvt", "jr", "sr")
# Thresholds of the resolver.
ACCEPT, CANDIDATE, LONG_TOKEN = 0.80, 0.50, 4

# Names that are organisations or collective subjects.
ORGANISATIONS = (
    "openai", "anthropic", "google", "alphabet", "google deepmind", "deepmind", "microsoft", "meta", "facebook",
    "instagram", "whatsapp", "amazon", "aws", "apple", "nvidia", "tesla", "spacex", "x", "twitter", "xai", "x.ai",
    "ibm", "oracle", "salesforce", "adobe", "intel", "amd", "samsung", "sony", "cerebras", "groq", "perplexity",
    "stability ai", "stability", "hugging face", "huggingface", "mistral", "mistral ai", "scale ai", "scale",
    "y combinator", "yc", "techcrunch", "the verge", "wired", "bloomberg", "reuters", "the new york times", "nyt",
    "the washington post", "wsj", "the wall street journal", "bbc", "cnn", "cnbc", "the information", "ftc", "sec",
    "doj", "fbi", "eu", "european union", "white house", "congress", "senate", "house", "supreme court", "the board",
    "the company", "the team", "the firm",
)
# Last words that mark a company.
SUFFIXES = ("inc", "corp", "corporation", "ltd", "limited", "llc", "llp", "gmbh", "ag", "sa", "plc", "pty", "bv", "nv", "holdings")
# What stands for a name that isn't known.
PLACEHOLDERS = ("unknown", "anonymous", "anon", "n/a", "na", "unspecified", "unattributed", "not specified", "no author", "no byline", "staff writer", "staff", "editor", "editorial staff", "the editors", "tba", "tbd")


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition holds ASCII: those with one such character, and the others."""
    single_from, single_to, several = [], [], {}
    for point in range(0x80, sys.maxunicode + 1):
        c = chr(point)
        if unicodedata.decomposition(c):
            ascii_part = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
            if len(ascii_part) == 1:
                single_from.append(c)
                single_to.append(ascii_part)
            elif ascii_part:
                several[c] = ascii_part
    return "".join(single_from), "".join(single_to), several


def ascii_fold(x: Column) -> Column:
    """Compatibility decomposition, then ASCII alone. Text that is ASCII already is only looked at."""
    one, to, several = _folds()
    table = F.create_map(*(F.lit(y) for pair in several.items() for y in pair))
    other = r"[^\x00-\x7f]"
    spell = lambda c: F.when(c > "\x7f", F.try_element_at(table, c)).otherwise(c)  # noqa: E731  null where nothing is left
    rest = lambda y: F.when(y.rlike(other), F.array_join(F.transform(F.split(y, ""), spell), "")).otherwise(y)
    return F.when(x.rlike(other), let(F.translate(x, one, to), rest)).otherwise(x)


def normalize(name: Column | str) -> Column:
    """Folded to ASCII, honorifics gone, lower case, letters and digits, single spaces."""
    x = ascii_fold(F.col(name) if isinstance(name, str) else name)
    x = F.regexp_replace(x, r"(?i)\b(" + "|".join(TITLES) + r")\.?\b", " ")
    x = F.regexp_replace(F.lower(x), r"[^a-z0-9\s]", " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def match_form(name: Column | str) -> Column:
    """Lower case with single spaces; punctuation and honorifics stay."""
    return strip(F.regexp_replace(F.lower(F.col(name) if isinstance(name, str) else name), r"(?U)\s+", " "))


def tokens(x: Column) -> Column:
    return F.filter(F.split(x, " "), lambda t: t != "")


def long_tokens(x: Column, least: int = LONG_TOKEN) -> Column:
    return F.array_distinct(F.filter(F.split(x, " "), lambda t: F.length(t) >= least))


def similarity(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)).cast("double")


def shares_long_token(a: Column, b: Column, least: int = LONG_TOKEN) -> Column:
    return F.arrays_overlap(long_tokens(a, least), long_tokens(b, least))


def is_subname(surface: Column, alias: Column, least: int = LONG_TOKEN) -> Column:
    """All long tokens of the surface, one at least, are tokens of the alias."""
    mine = long_tokens(surface, least)
    return (F.size(mine) > 0) & (F.size(F.array_except(mine, tokens(alias))) == 0)


def is_organisation(name: Column | str) -> Column:
    """Not a person: blank, a known organisation or placeholder, or a company by its last word."""
    last = lambda x: F.regexp_replace(F.substring_index(x, " ", -1), r"[.,;:!?]+$", "")
    return let(match_form(F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit(""))), lambda x: (x == "") | x.isin(*ORGANISATIONS, *PLACEHOLDERS) | last(x).isin(*SUFFIXES))


def relation_matches(predicted: Column, keywords: Column, *, fuzzy: bool) -> Column:
    """Strict: equal to a keyword. Fuzzy: holds a keyword. Both without case and outer white space."""
    said = F.lower(strip(predicted))
    test = (lambda k: F.contains(said, F.lower(strip(k)))) if fuzzy else (lambda k: F.lower(strip(k)) == said)
    return F.exists(keywords, test)


# The same rules on Python strings, for functions that keep state over rows in order.


def py_normalize(name: str) -> str:
    x = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    x = re.sub(r"\b(" + "|".join(TITLES) + r")\.?\b", " ", x, flags=re.IGNORECASE).lower()
    return " ".join(re.sub(r"[^a-z0-9\s]", " ", x).split())


def py_similarity(a: str, b: str) -> float:
    """By edit distance, a column of its table at a time as the bits of two integers (Myers, 1999)."""
    if a == b:
        return 1.0
    if len(a) < len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << i
    every, last = (1 << len(b)) - 1, 1 << len(b) >> 1
    up, down, distance = every, 0, len(b)
    for x in a:
        same = places.get(x, 0)
        vertical, across = same | down, (((same & up) + up) ^ up) | same
        rise, fall = down | (every & ~(across | up)), up & across
        distance += 1 if rise & last or not b else -1 if fall & last else 0
        rise, fall = rise << 1 | 1, fall << 1
        up, down = (fall | ~(vertical | rise)) & every, rise & vertical & every
    return 1.0 - distance / max(len(a), 1)


def py_long_tokens(x: str, least: int = LONG_TOKEN) -> set[str]:
    return {t for t in x.split() if len(t) >= least}
