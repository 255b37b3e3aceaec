"""Digests that Spark has no function for, as Arrow-batched UDFs."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of FNV-1a with 64 bits.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(text: str) -> str:
    """12 hex digits of FNV-1a-64 over UTF-16 code units, low byte first."""
    h = FNV_OFFSET
    for b in text.encode("utf-16-le", "surrogatepass"):
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return f"{h & 0xFFFFFFFFFFFF:012x}"


def _fnv(text: pd.Series) -> pd.Series:
    """``fnv1a`` of a batch: a step per byte, over all texts that are as long."""
    given = text.notna().to_numpy()
    data = [t.encode("utf-16-le", "surrogatepass") for t in text[given]]
    sizes = np.array([len(d) for d in data], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")  # the longest first: those that have a byte are a prefix
    flat, starts = np.frombuffer(b"".join(data), np.uint8), (np.cumsum(sizes) - sizes)[order]
    h, left = np.full(len(data), FNV_OFFSET, np.uint64), np.searchsorted(-sizes[order], -np.arange(sizes.max() if len(sizes) else 0), side="left")
    for j, n in enumerate(left):
        h[:n] = (h[:n] ^ flat[starts[:n] + j]) * np.uint64(FNV_PRIME)
    out = np.full(len(text), None, dtype=object)
    out[np.flatnonzero(given)[order]] = [f"{x & 0xFFFFFFFFFFFF:012x}" for x in h.tolist()]
    return pd.Series(out, index=text.index)


def _blake2(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else hashlib.blake2b(t.encode(), digest_size=6).hexdigest())


def fnv_digest(text: Column | str) -> Column:
    return F.pandas_udf(_fnv, "string")(text)


def blake2_digest(text: Column | str) -> Column:
    return F.pandas_udf(_blake2, "string")(text)


#: What parts the fields, the parts of a field and alternatives.
FIELD, SLOT, ALTERNATIVE = "\x1f", "\x1e", "\x1d"


def recipe_fingerprint(category: Column, outputs: Column, slots: Column) -> Column:
    """A recipe's identity that survives another numbering: its category, its
    outputs (array of key, qty), and its slots (array of alternatives, qty,
    role), each marked and in order, alternatives too.  Nulls are empty."""
    out = F.transform(F.array_sort(outputs), lambda o: F.concat(F.lit("o"), o.key, F.lit(SLOT), o.qty.cast("string")))
    sorted_slots = F.array_sort(F.transform(slots, lambda s: F.struct(F.array_join(F.array_sort(s.alternatives), ALTERNATIVE).alias("alts"), s.qty.alias("qty"), F.coalesce(s.role, F.lit("")).alias("role"))))
    used = F.transform(sorted_slots, lambda s: F.concat(F.lit("i"), s.alts, F.lit(SLOT), s.qty.cast("string"), F.lit(SLOT), s.role))
    return blake2_digest(F.array_join(F.concat(F.array(F.coalesce(category, F.lit(""))), out, used), FIELD))
