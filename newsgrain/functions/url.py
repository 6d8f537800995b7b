"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that do not change what a URL shows.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "referrer", "gclid", "fbclid")


def host_of(url: Column) -> Column:
    """Lower-case host without a leading www.; "" where there is none."""
    return F.regexp_replace(F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))), r"^www\.", "")


def _encode(x: Column) -> Column:
    return F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A"))


def canonicalize_url(url: Column) -> Column:
    """Percent-decoded, scheme and host in lower case, no tracking or blank parameters, the others sorted and encoded
    again, no fragment and no slash at the end of a path longer than "/". Null and empty give ""."""
    raw = F.trim(F.coalesce(url, F.lit("")))
    # a plus sign is no space in a path: it is shielded from the decoder, which takes forms
    u = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    net = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    path = F.when((F.length(path) > 1) & F.endswith(path, F.lit("/")), F.substr(path, F.lit(1), F.length(path) - 1)).otherwise(path)
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    form = lambda x: F.coalesce(F.try_url_decode(x), x)
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: F.contains(p, F.lit("=")) & (F.substring_index(p, "=", -1) != "")),
                        lambda p: F.struct(form(F.substring_index(p, "=", 1)).alias("k"), form(F.substr(p, F.instr(p, "=") + 1)).alias("v")))
    pairs = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*TRACKING)))
    q = F.array_join(F.transform(pairs, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")
    return F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(net != "", F.concat(F.lit("//"), net)).otherwise(""), path, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def url_key(url: Column) -> Column:
    """SHA-256 of the lower-case URL without white space around it and slashes at its end."""
    return F.sha2(F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), "/+$", ""), 256)
