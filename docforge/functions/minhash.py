"""MinHash signatures and LSH band keys.

* Token hash ``h``: the first 8 hex digits of md5(token), masked to 31 bits.
  ``str.split()`` of Python gives the tokens; its blanks are those of ``ws_tokens``.
* Permutation ``i``: ``(a_i * h + b_i) mod (2**31 - 1)``; the ``(a_i, b_i)``
  pairs are derived from ``seed`` by a fixed rule (md5 of ``"a:seed:i"`` /
  ``"b:seed:i"``), so the DuckDB oracle can rebuild them.
* Tokens, hashes and the 128 minima are computed by one Arrow-batched ``pandas_udf`` over the
  text (map-side, no shuffle).  A task keeps the hashes of up to 200,000 tokens (plus those of
  one text) that it has met; others are hashed anew.
* Empty token sets get the all-maximum signature (so they collide).
* Band key ``j``: md5 of the comma-joined slots ``j*rows .. j*rows+rows-1``.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import sql_tokens

MERSENNE = 2147483647          # 2**31 - 1
EMPTY_SLOT = 4294967295        # signature value of an empty token set


def perm_params(num_perm: int = 128, seed: int = 1) -> list[tuple[int, int]]:
    out = []
    for i in range(num_perm):
        a = 1 + int(hashlib.md5(f"a:{seed}:{i}".encode()).hexdigest()[:8], 16) % (MERSENNE - 1)
        b = int(hashlib.md5(f"b:{seed}:{i}".encode()).hexdigest()[:8], 16) % MERSENNE
        out.append((a, b))
    return out


def _minhasher(num_perm: int, seed: int):
    # the result only closes over numpy arrays and constants, so it is shipped to
    # the Python workers by value (workers need not import this package)
    params = np.array(perm_params(num_perm, seed), dtype=np.uint64)
    a, b = params[:, 0], params[:, 1]
    empty = np.full(num_perm, EMPTY_SLOT, dtype=np.int64)
    prime, bits = np.uint64(MERSENNE), np.uint64(31)
    block, most = 256, 200_000
    held = np.empty((2, block, num_perm), dtype=np.uint64)
    known = {}      # hashes by token

    def slots(h: np.ndarray) -> np.ndarray:
        """Minimum of (a * h + b) % prime of each permutation.  x = a * h + b is below
        prime ** 2, so (x & prime) + (x >> 31) has its remainder and is below 2 * prime;
        minus prime it wraps around to a large number where it was below prime."""
        x, y = held[:, :len(h)]
        np.multiply(h[:, None], a, out=x)
        x += b
        np.right_shift(x, bits, out=y)
        x &= prime
        x += y
        np.subtract(x, prime, out=y)
        return np.minimum(x, y, out=x).min(axis=0)

    def minima(tokens: set[str]) -> np.ndarray:
        if not tokens:
            return empty
        if len(known) > most:       # a bound of memory, not of tokens
            known.clear()
        new = [t for t in tokens if t not in known]
        if new:
            digests = b"".join([hashlib.md5(t.encode()).digest() for t in new])
            known.update(zip(new, (np.frombuffer(digests, dtype=">u4")[::4] & MERSENNE).tolist()))
        h = np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
        parts = [slots(h[s:s + block]) for s in range(0, len(h), block)]
        return functools.reduce(np.minimum, parts).astype(np.int64)

    return minima


def _signature_udf(num_perm: int, seed: int):
    minima = _minhasher(num_perm, seed)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def minhash_signature(texts: pd.Series) -> pd.Series:
        return pd.Series([minima(set(text.split()) if text else set()) for text in texts], dtype=object)

    return minhash_signature


def signature(text: Column, num_perm: int = 128, seed: int = 1) -> Column:
    """array<bigint> MinHash signature of the whitespace token set."""
    return _signature_udf(num_perm, seed)(text)


def band_keys(sig: Column, bands: int, rows: int) -> Column:
    """array<string> of ``bands`` band keys (md5 of the joined slots)."""
    return F.array(*[
        F.md5(F.array_join(F.slice(sig, j * rows + 1, rows).cast("array<string>"), ","))
        for j in range(bands)
    ])


def _dedup_keys_udf(num_perm: int, bands: int, rows: int, seed: int):
    minima = _minhasher(num_perm, seed)
    md5 = lambda text: hashlib.md5(text.encode()).hexdigest()

    @F.pandas_udf("struct<digest:string,bkeys:array<string>>")
    def dedup_keys(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            if text is None:
                out.append((None, None))
                continue
            tokens = set(text.split())
            slot = list(map(str, minima(tokens).tolist()))
            out.append((md5(" ".join(sorted(tokens))), [md5(",".join(slot[j * rows:(j + 1) * rows])) for j in range(bands)]))
        return pd.DataFrame(out, columns=["digest", "bkeys"], dtype=object)

    return dedup_keys


def dedup_keys(text: Column, num_perm: int, bands: int, rows: int, seed: int = 1) -> Column:
    """struct<digest, bkeys>: ``token_set_digest`` and ``band_keys`` of the ``signature`` of a text
    in one pass, which takes its tokens once; both null for a null text."""
    return _dedup_keys_udf(num_perm, bands, rows, seed)(text)


def jaccard_estimate(s1: Column, s2: Column) -> Column:
    """Share of equal signature slots."""
    eq = F.zip_with(s1, s2, lambda x, y: x == y)
    return (F.size(F.filter(eq, lambda e: e)).cast("double") / F.size(s1).cast("double"))


def _digest_udf():
    @F.pandas_udf(T.StringType())
    def token_set_md5(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else hashlib.md5(" ".join(sorted(set(t.split()))).encode()).hexdigest()
                          for t in texts], dtype=object)

    return token_set_md5


def token_set_digest(text: Column) -> Column:
    """md5 of the sorted distinct token set: equal iff the token sets are equal."""
    return _digest_udf()(text)


# --- SQL spellings ----------------------------------------------------------

def sql_perm_values(num_perm: int = 128, seed: int = 1) -> str:
    rows = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(perm_params(num_perm, seed)))
    return f"(VALUES {rows}) AS perm(i, a, b)"


def sql_signature_cte(table: str, key: str, text: str, num_perm: int = 128,
                      seed: int = 1) -> str:
    """CTE body: (key, sig BIGINT[]) for every row of ``table``."""
    return f"""
    SELECT d.{key} AS {key},
           CASE WHEN count(t.m) = 0 THEN list_transform(range({num_perm}), lambda x: {EMPTY_SLOT}::BIGINT)
                ELSE list(t.m ORDER BY t.i) END AS sig
    FROM {table} d
    LEFT JOIN (
        SELECT k, i, min((a * h + b) % {MERSENNE}) AS m
        FROM (
            SELECT DISTINCT {key} AS k,
                   ('0x' || substr(md5(tok), 1, 8))::BIGINT & {MERSENNE} AS h
            FROM (SELECT {key}, unnest({sql_tokens(text)}) AS tok FROM {table})
        ) x, {sql_perm_values(num_perm, seed)}
        GROUP BY k, i
    ) t ON t.k = d.{key}
    GROUP BY d.{key}
    """


def sql_band_keys(sig: str, bands: int, rows: int) -> list[str]:
    return [
        f"md5(array_to_string(list_slice({sig}, {j * rows + 1}, {j * rows + rows}), ','))"
        for j in range(bands)
    ]


def sql_token_set_digest(text: str) -> str:
    return f"md5(array_to_string(list_sort(list_distinct({sql_tokens(text)})), ' '))"


__all__ = [
    "perm_params", "signature", "band_keys", "jaccard_estimate",
    "token_set_digest", "dedup_keys", "sql_perm_values", "sql_signature_cte", "sql_band_keys",
    "sql_token_set_digest",
]
