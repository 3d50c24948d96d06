"""Scalar functions: identities, names, flags, ordered fingerprints."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The domain of derived object ids.
OBJECT_DOMAIN, MUTATION_DOMAIN, INODE_DOMAIN = "revlake.object\0", "revlake.mutation\0", "revlake.inode\0"


@F.pandas_udf(T.StringType())
def folded(names: pd.Series) -> pd.Series:
    return names.map(lambda s: None if s is None else unicodedata.normalize("NFC", s).casefold())


@F.pandas_udf(T.StringType())
def composed(names: pd.Series) -> pd.Series:
    return names.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def name_key(name: Column, case_sensitive: Column | None = None) -> Column:
    """NFC, and full case folding unless case_sensitive; ASCII names, nearly all of them, stay in the JVM."""
    plain = F.octet_length(name) == F.length(name)
    key = F.when(plain, F.lower(name)).otherwise(folded(name))
    if case_sensitive is None:
        return key
    return F.when(case_sensitive, F.when(plain, name).otherwise(composed(name))).otherwise(key)


def valid_name(name: Column) -> Column:
    return name.isNotNull() & F.octet_length(name).between(1, 255) & ~name.isin(".", "..") & ~name.rlike(r"[/\x00-\x1f\x7f]")


def object_id(mutation: Column) -> Column:
    """Lower-case hex of the first 16 bytes of the domain-separated digest."""
    return F.substring(F.sha2(F.concat(F.lit(OBJECT_DOMAIN).cast("binary"), mutation), 256), 1, 32)


def valid_link(target: Column) -> Column:
    return target.isNotNull() & F.octet_length(target).between(1, 4096) & ~target.contains("\0")


def big_endian(n: Column, width: int = 8) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 2 * width, "0"))


def prefixed(text: Column) -> Column:
    """The bytes of a text with their number before them."""
    return F.concat(big_endian(F.octet_length(text), 4), text.cast("binary"))


def mutation_id(tenant: Column, target: Column, issuer: Column, digest: Column) -> Column:
    """Hex of 32 bytes: the target revision, then the start of a digest over everything that the mutation is bound to."""
    material = F.concat(F.lit(MUTATION_DOMAIN).cast("binary"), prefixed(tenant), big_endian(target), prefixed(issuer), F.unhex(digest))
    return F.concat(F.lower(F.lpad(F.hex(target.cast("long")), 16, "0")), F.substring(F.sha2(material, 256), 1, 48))


def target_revision(mutation: Column) -> Column:
    return F.conv(F.substring(mutation, 1, 16), 16, 10).cast("long")


def stable_inode(object_id: Column, root: int = 1) -> Column:
    """The first of the digest's four words that lies above the root's inode, as an unsigned decimal text."""
    digest = F.sha2(F.concat(F.lit(INODE_DOMAIN).cast("binary"), F.unhex(object_id)), 256)
    words = [F.conv(F.substring(digest, 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)") for i in range(4)]
    return F.coalesce(*(F.when(w > root, w) for w in words), F.lit(root + 1).cast("decimal(20,0)")).cast("string")


def parent_path(path: Column) -> Column:
    """The path without its last part; empty for a path of one part."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def is_below(path: Column, root: Column) -> Column:
    """The root itself or anything under it."""
    return (path == root) | path.startswith(F.concat(root, F.lit("/")))


def budgeted_digest(fields: list[Column], most: int) -> Column:
    """Digest of fields with their lengths; null where their bytes exceed the budget."""
    size = sum((F.octet_length(f) for f in fields), F.lit(0))
    return F.when(size <= most, F.sha2(F.concat(*(prefixed(f) for f in fields)), 256))


def event_kind(flags: Column) -> Column:
    """Priority removed, renamed, created, modified, metadata."""
    names = ("removed", "renamed", "created", "modified")
    out = F.lit("metadata")
    for i in reversed(range(len(names))):
        out = F.when(flags.bitwiseAND(1 << i) != 0, names[i]).otherwise(out)
    return out


def ordered_fingerprint(key: Column, *fields: Column) -> Column:
    """Aggregate: digest of all rows in order of key, each field with its length before it."""
    row = F.concat(*(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")) for f in (key, *fields)))
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), row.alias("r")))), lambda x: x["r"]), "").cast("binary"), 256)
