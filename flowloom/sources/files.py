"""Opening files by the addresses that Spark lists them under."""

from __future__ import annotations

#: Schemes of Hadoop's connectors, and what the same stores are called outside of it.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs"}


def outside_hadoop(address: str) -> str:
    scheme, mark, rest = address.partition("://")
    return SCHEMES.get(scheme, scheme) + mark + rest


def located(address: str):
    """`(file system, path)` of an address, with credentials from the environment of the process that opens it."""
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(outside_hadoop(address))


def base_name(address: str) -> str:
    from urllib.parse import unquote

    return unquote(address.rsplit("/", 1)[-1])
