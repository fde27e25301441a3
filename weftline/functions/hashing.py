"""Identities: trajectory hashes, canonical record and table digests."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def trajectory_hash(tools: Column) -> Column:
    """12 hex digits of the MD5 of the tools joined by _. Sequences that differ only in where an
    underscore splits share a hash, so joins also compare the sequences."""
    return F.substring(F.md5(F.array_join(tools, "_")), 1, 12)


def shard_prefix(ident: Column) -> Column:
    return F.substring(F.md5(ident), 1, 4)


def canonical_map(fields: Column) -> Column:
    """A map<string,string> as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fields))))


def record_hash(fields: Column) -> Column:
    return F.md5(canonical_map(fields))


def table_hash(records: Column) -> Column:
    """Digest of a bag of record texts, for use over collected groups of bounded tables."""
    return F.sha2(F.array_join(F.array_sort(records), ","), 256)


@F.pandas_udf(T.StringType())
def combo_id(hashes: pd.Series, instances: pd.Series) -> pd.Series:
    """12 hex digits of the MD5 of the sorted-key JSON of a trajectory hash and its entity
    instances (a JSON text); byte-for-byte JSON needs Python here."""
    import hashlib

    def one(h, raw):
        body = json.dumps({"trajectory_hash": h, "entity_instances": json.loads(raw) if raw else {}}, sort_keys=True, ensure_ascii=False)
        return hashlib.md5(body.encode()).hexdigest()[:12]

    return pd.Series([one(h, r) for h, r in zip(hashes, instances)], dtype=object)


def sample_id(first_user: Column, tools: Column) -> Column:
    """MD5 of the first user message and the tools' texts in order of themselves."""
    return F.md5(F.concat(F.coalesce(first_user, F.lit("")), F.array_join(F.array_sort(F.coalesce(tools, F.array().cast("array<string>"))), ",")))


def task_id(server: Column, trajectory: Column, combo: Column) -> Column:
    """server and the first 8 hex digits of the MD5 of each of the others."""
    return F.concat_ws("_", server, F.substring(F.md5(trajectory), 1, 8), F.substring(F.md5(combo), 1, 8))


def context_id(trajectory_hash: Column, context: Column) -> Column:
    """12 hex digits of the MD5 of {"entity_context": ..., "trajectory_hash": ...}; the context is a JSON text with
    sorted keys and `, ` and `: ` between."""
    body = F.concat(F.lit('{"entity_context": '), context, F.lit(', "trajectory_hash": "'), trajectory_hash, F.lit('"}'))
    return F.substring(F.md5(body), 1, 12)


def query_id(result: Column) -> Column:
    return F.substring(F.md5(result), 1, 8)


def canonical_json(document: Column) -> Column:
    """The one form of a JSON text: keys sorted at every depth, no white space, numbers without needless digits (1.50 and
    15e-1 are 1.5). Null for what is no JSON. It is what Python writes for the value with sorted keys and bare
    separators, but for whole floats, which lose their fraction, and control characters, whose codes are in capitals."""
    return F.to_json(F.try_parse_json(document))


def bag_digest(document: Column) -> Column:
    """An aggregate: one digest for a bag of texts in any order. Rows add up, so that a table of any size is summed where
    it lies and repeats count; null rows count as empty texts."""
    hashed = F.md5(F.coalesce(document, F.lit("")))
    half = lambda at: F.sum(F.conv(F.substring(hashed, at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return F.md5(F.concat_ws(":", F.count(F.lit(1)).cast("string"), half(1), half(16)))


def nested_digests(records: DataFrame, key: list[str], document: str) -> DataFrame:
    """key, n, digest: tables of nested records (JSON texts) that are equal up to the order of rows and keys have equal digests."""
    return records.groupBy(*key).agg(F.count("*").alias("n"), bag_digest(canonical_json(F.col(document))).alias("digest"))
