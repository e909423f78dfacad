"""Scores of answers, runs and retrieval, as column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """In double precision, element by element."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def retrieval_score(recall: Column, mean_similarity: Column, weight: float = 0.5) -> Column:
    return weight * recall + (1 - weight) * mean_similarity


def overlap_ramp(similarity: Column, limit: float = 0.8, slope: float = 5.0) -> Column:
    """1 up to the limit, then falling to 0."""
    return F.when(similarity <= limit, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - slope * (similarity - limit)))


def predictability(logprobs: Column, scale: float = 3.0) -> Column:
    """exp of the mean log-probability over scale, clipped to [0, 1]; 0 without tokens."""
    mean = F.aggregate(logprobs, F.lit(0.0), lambda s, x: s + x) / F.size(logprobs)
    return F.when(F.size(logprobs) > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(mean / scale)))).otherwise(0.0)


def composite(mode: Column, form: Column, similarity: Column, retrieval: Column, overlap: Column, predicted: Column) -> Column:
    """The reward of a mode: prs, fas, ppl, else the form alone."""
    return (
        F.when(mode == "prs", 0.8 * similarity + 0.2 * form)
        .when(mode == "fas", 0.6 * retrieval + 0.2 * form + 0.2 * overlap_ramp(overlap))
        .when(mode == "ppl", 0.8 * predicted + 0.2 * form)
        .otherwise(form)
    )


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """1 - C(n-c, k) / C(n, k) in product form; NaN where n < k, 1 where fewer than k failed."""
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda a, i: a * (n - c - i) / (n - i))
    return F.when(n < k, F.lit(float("nan"))).when(n - c < k, 1.0).otherwise(1 - miss)


def improvement(metric: Column, baseline: Column, lower_is_better: Column) -> Column:
    return F.when(lower_is_better, baseline - metric).otherwise(metric - baseline)


def hmac_sha256(message: Column, key: bytes) -> Column:
    """Lower-case hex of the keyed digest of a text."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def signed(value: Column, signature: Column, key: bytes) -> Column:
    """Whether a signature is that of the value with six decimals; false without one."""
    text = F.regexp_replace(F.format_number(value, 6), ",", "")
    return F.coalesce(hmac_sha256(text, key) == signature, F.lit(False))
