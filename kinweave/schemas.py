"""Schemas of the graph's tables and records, and additive evolution of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {"STRING": T.StringType(), "INT": T.IntegerType(), "TIMESTAMP": T.TimestampType()}


def schema(columns: str) -> T.StructType:
    """Flat columns, without a session: workers import this module too."""
    return T.StructType([T.StructField(x.split()[0], _TYPES[x.split()[1]]) for x in columns.split(", ")])


PEOPLE = schema("person_id STRING, canonical_name STRING, bio STRING")
ALIASES = schema("alias_id STRING, surface_form STRING, person_id STRING")
ARTICLES = schema("article_id STRING, url STRING, title STRING, author STRING, published_at TIMESTAMP, source STRING, body_hash STRING, sentences_per_chunk INT, total_chunks INT, chunks_processed INT")
RELATIONSHIPS = schema("rel_id STRING, source_person_id STRING, target_person_id STRING, relation_type STRING, explanation STRING")
PROVENANCE = schema("prov_id STRING, rel_id STRING, article_id STRING, quote STRING")
TABLES = {"people": PEOPLE, "aliases": ALIASES, "articles": ARTICLES, "relationships": RELATIONSHIPS, "provenance": PROVENANCE}

PERSON = "STRUCT<name: STRING, role: STRING>"
EDGE = "STRUCT<source_person: STRING, target_person: STRING, relation_type: STRING, explanation: STRING, supporting_quote: STRING>"
EXTRACTION_DDL = f"people ARRAY<{PERSON}>, relationships ARRAY<{EDGE}>"
ARTICLE_CONTENT = schema("url STRING, title STRING, author STRING, published_at TIMESTAMP, body_text STRING, source STRING")
_STRUCTS = [T.StructField(name, T.ArrayType(schema(fields))) for name, fields in (("people", "name STRING, role STRING"), ("relationships", "source_person STRING, target_person STRING, relation_type STRING, explanation STRING, supporting_quote STRING"))]
CHUNK_EXTRACTION = T.StructType([*schema("article_id STRING, body_hash STRING, chunk_size INT, chunk_idx INT").fields, *_STRUCTS, T.StructField("error", T.StringType())])


def stable_id(*parts: Column | str) -> Column:
    """An id that depends on the natural key alone, so retries make the same row."""
    return F.sha2(F.concat_ws("\u0001", *(F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("\u0002")) for p in parts)), 256)


def evolve(df: DataFrame, target: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """``df`` in the target schema: missing columns are added with their default or null, none is lost by running it twice."""
    defaults = defaults or {}
    out = []
    for field in target.fields:
        default = F.lit(defaults.get(field.name)).cast(field.dataType)
        value = F.coalesce(F.col(field.name).cast(field.dataType), default) if field.name in df.columns else default
        out.append(value.alias(field.name))
    return df.select(*out)


def evolve_articles(df: DataFrame) -> DataFrame:
    return evolve(df, ARTICLES, {"chunks_processed": 0})
