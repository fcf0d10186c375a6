"""Text preparation as Column expressions: strip, sentences, chunks, hashes, prompts, dates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_CHUNK = 5


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, however often f uses it, inside lambdas too."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def strip(x: Column | str) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(_col(x), r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def clean(x: Column | str) -> Column:
    """No-break spaces become spaces; then strip."""
    return strip(F.translate(_col(x), " ", " "))


def filled(x: Column | str) -> Column:
    """Null where empty."""
    return F.nullif(_col(x), F.lit(""))


def first_filled(*xs: Column | str) -> Column:
    return F.coalesce(*(filled(x) for x in xs))


def sentences(text: Column | str) -> Column:
    """Cut after . ! or ? before white space; stripped, without empties."""
    parts = F.split(_col(text), r"(?U)(?<=[.!?])\s+")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def chunks(parts: Column | str, size: Column | int) -> Column:
    """Groups of ``size`` consecutive sentences, joined by a space."""
    size = F.lit(size) if isinstance(size, int) else size

    def cut(parts: Column) -> Column:
        n = F.size(parts)
        starts = F.sequence(F.lit(0), F.ceil(n / size).cast("int") - 1)
        joined = F.transform(starts, lambda i: F.array_join(F.slice(parts, i * size + 1, size), " "))
        return F.when(n > 0, joined).otherwise(F.array().cast("array<string>"))

    return let(_col(parts), cut)


def chunk_size(requested: Column | str, default: int = DEFAULT_CHUNK) -> Column:
    """The default stands for null and 0."""
    return F.coalesce(F.nullif(_col(requested).cast("int"), F.lit(0)), F.lit(default))


def body_hash(text: Column | str) -> Column:
    return F.sha2(_col(text), 256)


def message(title: Column, author: Column, url: Column, chunk: Column, idx: Column, total: Column) -> Column:
    """What an extractor is asked: heading lines that are there, then the numbered excerpt."""
    labelled = lambda name, x: F.when(filled(x).isNotNull(), F.concat(F.lit(name), x))
    return F.concat_ws("\n", labelled("Title: ", title), labelled("Author: ", author), F.concat(F.lit("URL: "), url), F.concat(F.lit("Excerpt ("), (idx + 1).cast("string"), F.lit("/"), total.cast("string"), F.lit("):")), chunk)


def iso_time(x: Column | str) -> Column:
    """ISO timestamps, Z or an offset or neither; anything else is null."""
    x = strip(x)
    fits = x.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$")
    return F.when(fits, F.try_to_timestamp(x))


def long_date(x: Column | str) -> Column:
    """The first date such as May 22, 2026 in a text."""
    found = F.regexp_extract(_col(x), r"([A-Z][a-z]+ \d{1,2}, \d{4})", 1)
    return F.try_to_timestamp(filled(found), F.lit("MMMM d, yyyy"))


def published_at(meta: Column, time_attr: Column, time_text: Column, container: Column) -> Column:
    """The cascade of a page's dates: meta tag, time element (attribute, else text), free text near the byline."""
    shown = first_filled(time_attr, time_text)
    return F.coalesce(iso_time(meta), iso_time(shown), long_date(shown), long_date(container))


def firsts(xs: Column, key: Callable[[Column], Column]) -> Column:
    """The first item of each key, in order: by two sorts, so that long lists don't cost the square of their length."""
    rows = F.array_sort(F.transform(xs, lambda x, i: F.struct(key(x).alias("key"), i.alias("i"))))
    places = let(rows, lambda rs: F.filter(rs, lambda r, n: (n == 0) | (F.get(rs, n - 1)["key"] != r["key"])))
    return let(xs, lambda ys: F.transform(F.array_sort(F.transform(places, lambda r: r["i"])), lambda i: F.get(ys, i)))


def distinct_names(names: Column | str) -> Column:
    """Names without repeats in another case, in order."""
    blank = r"(?U)[\s\x1c-\x1f]"
    stripped = lambda x: F.when(x.rlike(blank), strip(x)).otherwise(x)
    names = F.filter(F.transform(_col(names), lambda x: let(F.translate(x, "\u00a0", " "), stripped)), lambda x: x != "")
    return let(names, lambda ns: firsts(ns, F.lower))
