"""Addresses and the identity keys made of them. The keys differ on purpose; each says what it ignores."""

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from framelight.functions.binding import let
from framelight.functions.fixed_values import PAGE_KEYS
from framelight.functions.text import casefold, clean_text


def bare(url: Column) -> Column:
    """Without fragment and final slashes, case folded; the query stays."""
    return casefold(F.rtrim(F.split(F.coalesce(url, F.lit("")), "#")[0], F.lit("/")))


def candidate_key(product_url: Column, image_url: Column, name: Column) -> Column:
    """A product's key for operators' choices: its address, or its image's, or its name."""
    product, image = F.trim(bare(product_url)), F.trim(casefold(F.split(F.coalesce(image_url, F.lit("")), "#")[0]))
    named = casefold(clean_text(F.coalesce(name, F.lit("Unnamed product"))))
    return F.when(product != "", F.concat(F.lit("product::"), product)).when(image != "", F.concat(F.lit("image::"), image)).otherwise(F.concat(F.lit("name::"), named))


def one_line(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|\s+$", ""), r"[\t\r\n]", "")


def parts_of_line(text: Column) -> dict[str, Column]:
    take = lambda i: F.regexp_extract(text, r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?:(//)([^/?#]*))?([^?#]*)(?:\?([^#]*))?", i)
    return {"scheme": F.lower(take(1)), "where": F.when(take(2) != "", take(3)), "path": take(4), "query": take(5)}


def parts_of(url: Column) -> dict[str, Column]:
    """scheme, where (null: none), path and query as they stand; white space around and line breaks within do not count."""
    return parts_of_line(one_line(url))


def sorted_query(query: Column) -> Column:
    """Names and values as form data, in one spelling, sorted; values may be empty, empty pairs go."""
    plain = lambda c: F.try_url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))  # noqa: E731  a % that begins nothing stands for itself
    coded = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    name, value = (lambda p: F.regexp_extract(p, "^([^=]*)", 1)), (lambda p: F.regexp_extract(p, "(?s)^[^=]*=(.*)", 1))
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(plain(name(p)).alias("k"), plain(value(p)).alias("v")))
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(coded(p["k"]), F.lit("="), coded(p["v"]))), "&")


def put_together(scheme: Column, where: Column, path: Column, query: Column) -> Column:
    asked = sorted_query(query)
    return F.concat(F.when(scheme == "", "").otherwise(F.concat(scheme, F.lit(":"))), F.when(where.isNull(), "").otherwise(F.concat(F.lit("//"), where)), path, F.when(asked == "", "").otherwise(F.concat(F.lit("?"), asked)))


def readable_host(where: Column) -> Column:
    """Whether what stands between // and the path can be read: brackets only around an address, a port that is a number."""
    return where.rlike(r"^(?:[^@]*@)*(?:[^\[\]@]*|\[[0-9A-Fa-f:.%]+\](?::[0-9]*)?)$")


def canonical_http_url(url: Column | str) -> Column:
    """One text for all spellings of an http address, '' for all else: scheme and host in lower case, no default port, single slashes, none at the
    end, the query sorted, no fragment and no user."""
    p = parts_of(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")))
    own = F.regexp_extract(p["where"], r"([^@]*)$", 1)
    bracket = F.regexp_extract(own, r"^\[([^\]]*)\]", 1)
    host = F.lower(F.rtrim(F.when(bracket != "", bracket).otherwise(F.regexp_extract(own, r"^([^:]*)", 1)), F.lit(".")))
    port = F.regexp_extract(own, r":([^:\]]*)$", 1)
    number = F.when(port.rlike("^[0-9]{1,9}$"), port.try_cast("int"))
    fine = p["scheme"].isin("http", "https") & readable_host(p["where"]) & (host != "") & ((port == "") | F.coalesce(number <= 65535, F.lit(False)))
    default = number == F.when(p["scheme"] == "http", 80).otherwise(443)
    where = F.when((port == "") | (number == 0) | default, host).otherwise(F.concat(host, F.lit(":"), number.cast("string")))
    path = F.regexp_replace(F.when(p["path"] == "", "/").otherwise(p["path"]), "//+", "/")
    return F.when(F.coalesce(fine, F.lit(False)), put_together(p["scheme"], where, F.when(path == "/", path).otherwise(F.rtrim(path, F.lit("/"))), p["query"])).otherwise("")


def canonical_listing_url(url: Column | str) -> Column:
    """As canonical_http_url, for pages of a listing: the port stays, any scheme is taken; null for an address that cannot be read. It is taken apart once."""

    def made(p: Column) -> Column:
        path = F.rtrim(F.regexp_replace(F.when(p["path"] == "", "/").otherwise(p["path"]), "/+", "/"), F.lit("/"))
        whole = put_together(p["scheme"], F.lower(p["where"]), F.when(path == "", "/").otherwise(path), p["query"])
        return F.when(p["where"].isNull() | readable_host(p["where"]), whole)

    return let(let(one_line(F.col(url) if isinstance(url, str) else url), lambda text: F.struct(*[c.alias(k) for k, c in parts_of_line(text).items()])), made)


def joined_url(base: str | None, href: str | None) -> str | None:
    """href as seen from base; None for what cannot be read as an address."""
    try:
        return None if href is None else urljoin(base or "", href)
    except ValueError:
        return None


@F.pandas_udf(StringType())
def absolute(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([joined_url(b, h) for b, h in zip(base, href, strict=True)])


def match_url(url: Column) -> Column:
    """For remembered settings: scheme, host and path; query and fragment go."""
    text = F.trim(F.coalesce(url, F.lit("")))
    parts = lambda i: F.regexp_extract(text, r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)", i)
    path = F.regexp_replace(F.when(parts(3) == "", F.lit("/")).otherwise(parts(3)), "/+$", "")
    scheme = F.when(parts(1) != "", F.concat(F.lower(parts(1)), F.lit(":"))).otherwise("")
    return F.when(text == "", F.lit("")).otherwise(F.concat(scheme, F.when(parts(2) != "", F.concat(F.lit("//"), F.lower(parts(2)))).otherwise(""), path))


def same_origin(a: Column, b: Column) -> Column:
    origin = lambda u: F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    return origin(a) == origin(b)


def page_number(url: Column) -> Column:
    """From the query's page keys, else from the path; null if neither has one."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    of_query = F.regexp_extract(query, r"(?i)(?:^|&)(?:" + "|".join(PAGE_KEYS) + r")=[^&\d]*(\d+)", 1)
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    found = [of_query, *(F.regexp_extract(path, rf"(?i){p}(\d+)(?:/|$)", 1) for p in ("/page/", "/page-", "/p/"))]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in found]).try_cast("long")


def is_paginated(url: Column) -> Column:
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    path = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1))
    return query.rlike(r"(?i)(?:^|&)(?:" + "|".join(PAGE_KEYS) + r")(?:=|&|$)") | path.rlike(r"/page/\d+/?$|/page-\d+/?$|/p/\d+/?$")


def is_public_literal(url: Column) -> Column:
    """Whether an address may be fetched as far as its text tells: http(s), a host, no credentials, no private host.
    What a host name resolves to is for the fetcher to check."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.lower(F.rtrim(F.regexp_replace(authority, r":\d*$", ""), F.lit(".")))
    private = host.rlike(r"^(localhost|.*\.(localhost|local|internal|lan|home)|0\.0\.0\.0|127\..*|10\..*|192\.168\..*|169\.254\..*|172\.(1[6-9]|2\d|3[01])\..*|100\.(6[4-9]|[789]\d|1[01]\d|12[0-7])\..*|22[4-9]\..*|2[34]\d\..*|25[0-5]\..*|\[.*\])$")
    return F.coalesce(scheme.isin("http", "https") & (host != "") & readable_host(authority) & ~authority.contains("@") & ~private, F.lit(False))
