"""URLs, markup and region keys as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DROPPED = ("fbclid", "gclid")


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, tracking parameters dropped, the rest sorted, no fragment."""
    plain = F.regexp_replace(url, "#.*$", "")
    query = F.regexp_extract(plain, r"\?(.*)$", 1)
    base = F.regexp_replace(plain, r"\?.*$", "")
    head = F.lower(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1))
    path = F.regexp_replace(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(r"^utm_") & ~F.lower(F.regexp_replace(p, "=.*$", "")).isin(*DROPPED)))
    return F.concat(head, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def normalized_url(url: Column) -> Column:
    """Scheme and host in lower case and the path, without a trailing slash, query or fragment."""
    plain = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/+$", "")
    head = F.regexp_extract(plain, "^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    return F.concat(F.lower(head), F.substring(plain, F.length(head) + 1, F.length(plain)))


def normal_address(url: str) -> str:
    """``normalized_url`` of a given text."""
    head, mark, rest = re.split("[?#]", url)[0].rstrip("/").partition("://")
    place, slash, path = rest.partition("/")
    return f"{head.lower()}{mark}{place.lower()}{slash}{path}" if mark else head


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)", 1))


def region_key(*parts: str | Column) -> Column:
    """A hash that names a region by its source and place."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def first_known(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


#: Fields of a record that are its fingerprint, the first known one first.
FINGERPRINTS = ("content_hash", "image_hash", "sha256", "pixel_hash", "region_hash", "phash")


def fingerprint(fields: Column, content: Column, source: Column, url: Column, hex_: Column, region: Column) -> Column:
    """A record's fingerprint: the first known of its fields (a map) of FINGERPRINTS, else the hash of its file's bytes, else that of what names it, as JSON with sorted keys."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    said = F.concat(F.lit('{"hex": '), quoted(hex_), F.lit(', "region": '), quoted(region), F.lit(', "source": '), quoted(source), F.lit(', "url": '), quoted(url), F.lit("}"))
    own = [F.try_element_at(fields, F.lit(k)) for k in FINGERPRINTS]
    return F.coalesce(*[F.when(c != "", c) for c in own], F.sha2(content, 256), F.sha2(F.encode(said, "UTF-8"), 256))


def json_alias(body: Column, *names: str) -> Column:
    """The first known value of an object under one of several names (lower case) in any case; [] and {} are none."""
    fields = F.transform_keys(F.from_json(body, "map<string,string>", {"mode": "PERMISSIVE"}), lambda k, _: F.lower(k))
    known = lambda c: F.when(~F.trim(c).isin("", "[]", "{}"), c)
    return F.coalesce(*[known(F.element_at(fields, n)) for n in names])
