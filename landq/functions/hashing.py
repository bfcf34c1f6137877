"""Hash payloads and signatures."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

GENESIS = "0" * 64


def payload(*columns: Column) -> Column:
    """One JSON array in a fixed column order: unambiguous for any content, nulls kept apart."""
    return F.to_json(F.array(*[F.coalesce(c.cast("string"), F.lit("\u0000")) for c in columns]))


def chain_hash(previous: Column, body: Column) -> Column:
    return F.sha2(F.concat(previous, body), 256)


def chain_step(previous: str, body: str) -> str:
    """The same hash outside the JVM, for the steps that depend on the row before."""
    return hashlib.sha256((previous + body).encode("utf-8")).hexdigest()


#: Bytes of a block of the hash: keys are padded to this length, longer ones hashed first.
BLOCK = 64


def key_pads(secret: Column) -> Column:
    """struct<inner, outer> of hex digits, the two pads of a signing key; worked out once for each key."""
    raw = secret.cast("binary")
    key = F.when(F.length(raw) > BLOCK, F.sha2(raw, 256)).otherwise(F.lower(F.hex(raw)))
    padded = F.rpad(key, 2 * BLOCK, "0")
    # a digit at a time: exclusive or with 36 and 5c
    pad = lambda even, odd: F.concat(
        *(F.translate(F.substr(padded, F.lit(i + 1), F.lit(1)), "0123456789abcdef", even if i % 2 == 0 else odd) for i in range(2 * BLOCK))
    )
    digits = "0123456789abcdef"
    xored = {m: "".join(digits[d ^ m] for d in range(16)) for m in (3, 5, 6, 12)}
    return F.struct(pad(xored[3], xored[6]).alias("inner"), pad(xored[5], xored[12]).alias("outer"))


def signed(body: Column, pads: Column) -> Column:
    """Keyed SHA-256 signature of a text from the pads of its key."""
    inner = F.sha2(F.concat(F.unhex(pads["inner"]), body.cast("binary")), 256)
    return F.sha2(F.concat(F.unhex(pads["outer"]), F.unhex(inner)), 256)


def hmac_sha256(body: Column, secret: Column) -> Column:
    return signed(body, key_pads(secret))
