"""Encrypted texts: AES-256 in GCM mode, written as ``enc:`` and the parts iv, tag and data in base64, joined by points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from billforge.functions.address import let

# The mark of an encrypted text, and the bytes of its iv and tag.
MARK = "enc:"
IV_BYTES = 12
TAG_BYTES = 16


def _key(secret: Column) -> Column:
    """The key: sha256 of the secret; a blank secret is an error."""
    blank = F.trim(F.coalesce(secret, F.lit(""))) == ""
    return F.when(blank, F.raise_error(F.lit("a secret is needed to encrypt or decrypt"))).otherwise(F.unhex(F.sha2(secret.cast("binary"), 256)))


def encrypted(text: Column, secret: Column, iv: Column | None = None) -> Column:
    """``text`` encrypted under ``secret``; null, empty and encrypted texts stay. A given ``iv`` (12 bytes) must not be used twice."""
    sealed = F.aes_encrypt(text.cast("binary"), _key(secret), F.lit("GCM"), F.lit("NONE"), *([iv] if iv is not None else []))

    def parts(x: Column) -> Column:
        n = F.octet_length(x)
        cuts = ((F.lit(1), F.lit(IV_BYTES)), (n - TAG_BYTES + 1, F.lit(TAG_BYTES)), (F.lit(IV_BYTES + 1), n - IV_BYTES - TAG_BYTES))
        return F.concat_ws(".", *(F.regexp_replace(F.base64(F.substring(x, a, k)), r"\s", "") for a, k in cuts))

    told = F.concat(F.lit(MARK), let(sealed, parts))  # each evaluation takes a new iv, so there is one only
    return F.when((text == "") | text.startswith(MARK), text).when(text.isNotNull(), told)


def decrypted(text: Column, secret: Column) -> Column:
    """What encrypted() has hidden; null and plain texts stay, a broken mark, tag or data is an error."""

    def opened(part: Column) -> Column:
        given = F.struct(*(F.unbase64(F.try_element_at(part, F.lit(k))).alias(n) for k, n in enumerate(("iv", "tag", "data"), start=1)))

        def read(x: Column) -> Column:
            broken = x["iv"].isNull() | x["tag"].isNull() | x["data"].isNull() | (F.octet_length(x["iv"]) != IV_BYTES) | (F.octet_length(x["tag"]) != TAG_BYTES)
            return F.when(broken, F.raise_error(F.lit("not a valid encrypted value"))).otherwise(F.aes_decrypt(F.concat(x["iv"], x["data"], x["tag"]), _key(secret), F.lit("GCM")).cast("string"))

        return let(given, read)

    return F.when(~text.startswith(MARK), text).when(text.isNotNull(), let(F.split(F.substring(text, len(MARK) + 1, 1_000_000_000), r"\."), opened))
