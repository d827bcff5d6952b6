"""Addresses in one form (T9, T10), with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Parameters of an address that only say where a reader came from, and families of them by beginning.
TRACKING = (
    "fbclid gclid dclid msclkid mc_cid mc_eid igshid ref ref_src cmpid ocid at_medium at_campaign xtor smid _ga guccounter "
    "output amp outputtype rss from source s_cid"
).split()
TRACKING_FAMILIES = {"utm_": r"\w+", "at_custom": r"\d+", "ns_": r"\w+"}
_TRACKED = "(?i)^(" + "|".join([*TRACKING, *(f"{k}{rest}" for k, rest in TRACKING_FAMILIES.items())]) + ")$"
#: Where a path says that it leads to the AMP version of a page.
_AMP = r"(?i)(/amp/?$|/amp/(?=.)|\.amp$|\.amp\.html$)"


def domain_of(url: Column) -> Column:
    """Host in lower case without www. and m."""
    host = F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    bare = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r"^m\.", "")
    return F.when(bare == "", None).otherwise(bare)


def canonical_url(url: Column) -> Column:
    """https, lower-case host, no default port, AMP, tracking, blank parameters, fragment; parameters sorted and written anew."""
    port = F.regexp_extract(F.trim(url), r"^[A-Za-z]+://(?:[^/?#@]*@)?[^/?#:]+:(\d+)", 1)
    kept_port = F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port))
    path = F.regexp_extract(F.trim(url), r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(F.when(path == "", "/").otherwise(path), _AMP, "/"), "//+", "/")
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)
    query = F.regexp_extract(F.trim(url), r"^[^?#]*\?([^#]*)", 1)
    plain = lambda c: F.coalesce(F.try_url_decode(c), c)
    parts = F.transform(F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]+=.")), lambda p: F.struct(plain(F.substring_index(p, "=", 1)).alias("k"), plain(F.regexp_replace(p, "^[^=]*=", "")).alias("v")))
    kept = F.array_sort(F.filter(parts, lambda p: ~p["k"].rlike(_TRACKED)))
    # A tilde needs no escape, an asterisk does.
    coded = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    tail = F.array_join(F.transform(kept, lambda p: F.concat(coded(p["k"]), F.lit("="), coded(p["v"]))), "&")
    whole = F.concat(F.lit("https://"), domain_of(url), kept_port, path, F.when(tail == "", "").otherwise(F.concat(F.lit("?"), tail)))
    return F.when(domain_of(url).isNotNull(), whole)


def url_hash(url: Column) -> Column:
    return F.sha2(canonical_url(url), 256)
