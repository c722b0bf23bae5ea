"""Analyzer for the full-text fields (F1-F4), as Spark column expressions.

A token is a maximal run of alphabetic or numeric characters; tokens are
numbered in text order, tokens of 40 bytes or more are then dropped without
renumbering the rest, and the survivors are lower-cased.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the analyzer.
TOKEN_SEPARATOR = r"[^\p{IsAlphabetic}\p{N}]+"
TOKEN_PATTERN = r"([\p{IsAlphabetic}\p{N}]+)"
MAX_TOKEN_BYTES = 40


def raw_tokens(text: Column) -> Column:
    """All alphanumeric runs of ``text`` in order (no empty strings)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), TOKEN_SEPARATOR), lambda t: t != "")


def _kept(t: Column) -> Column:
    return F.octet_length(t) < MAX_TOKEN_BYTES


def terms(text: Column) -> Column:
    """Indexed terms of ``text`` in order, positions not kept."""
    return F.transform(F.filter(raw_tokens(text), _kept), lambda t: F.lower(t))


def field_length(text: Column) -> Column:
    """Number of indexed tokens (the BM25 document length of a field)."""
    return F.size(F.filter(raw_tokens(text), _kept))


def tags_text(tags: Column) -> Column:
    """Tags become one text, joined by a single space."""
    return F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " ")


def explode_terms(df: DataFrame, text_col: str, keep: list[str], tokens_col: str | None = None) -> DataFrame:
    """One row per indexed token: ``keep`` columns + ``pos`` + ``term``.

    Positions are assigned before the long-token filter, so a dropped token
    leaves a gap (phrase matching across it fails, as in the reference).
    ``tokens_col`` names an existing ``raw_tokens`` array to reuse.
    """
    toks = F.col(tokens_col) if tokens_col else raw_tokens(F.col(text_col))
    return (
        df.select(*keep, F.posexplode(toks).alias("pos", "tok"))
        .where(_kept(F.col("tok")))
        .select(*keep, F.col("pos").cast("int").alias("pos"), F.lower("tok").alias("term"))
    )


def pieces(text: Column) -> Column:
    """The runs of ``text`` in order, lower-cased, null where too long; a text may begin or end with an empty one. For ``kept_places``."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), TOKEN_SEPARATOR), lambda t: F.when(_kept(t), F.lower(t)))


def kept_places(tokens: pa.Array, analysed: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(list, pos, term) of the indexed tokens of lists of ``pieces``, numbered before the long ones are dropped.

    Lists that are not ``analysed`` hold values, which are kept whole.
    """
    n = np.diff(tokens.offsets.to_numpy())
    flat, of = tokens.flatten(), np.repeat(np.arange(len(n)), n)
    size = pc.fill_null(pc.binary_length(flat), -1).to_numpy()
    numbered = (size != 0) | ~analysed[of]
    seen = np.r_[0, np.cumsum(numbered)]
    first = np.r_[0, np.cumsum(n)][:-1]
    at = np.flatnonzero(numbered & (size >= 0))
    return of[at], seen[at] - seen[first][of[at]], flat.take(pa.array(at))


def kept_count(tokens: Column) -> Column:
    """Number of indexed tokens in a ``raw_tokens`` array."""
    return F.size(F.filter(tokens, _kept))
