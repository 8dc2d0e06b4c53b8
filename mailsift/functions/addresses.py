"""Address expressions: domain and pseudonyms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mailsift import fixed


def domain(addr: Column) -> Column:
    """Lower-case text after the last ``@`` (the whole text without one)."""
    known = F.lower(F.element_at(F.split(addr, "@"), -1))
    return F.when(addr.isNull() | (addr == fixed.UNKNOWN), fixed.UNKNOWN).otherwise(known)


def pseudonym(addr: Column, key: str | None = None) -> Column:
    """SHA-256 hex of the address. With ``key`` it is salted, so known addresses cannot be looked up."""
    text = addr if key is None else F.concat(F.sha2(F.lit(key), 256), addr)
    return F.when(addr.isNull() | (addr == fixed.UNKNOWN), fixed.UNKNOWN).otherwise(F.sha2(text, 256))


def short_pseudonym(addr: Column) -> Column:
    """First 16 hex characters; null and empty become ``unknown``."""
    return F.when(addr.isNull() | (addr == ""), fixed.UNKNOWN).otherwise(
        F.substring(F.sha2(addr, 256), 1, 16)
    )
