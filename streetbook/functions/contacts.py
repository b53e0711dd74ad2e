"""Websites, phones and URL keys found in text and links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from streetbook.dicts import phrases as P
from streetbook.dicts import sites as S
from streetbook.functions.expr import blank_to_null, col, let, quote


def _names_host(value: Column, hosts: Sequence[str]) -> Column:
    out = F.lit(False)
    for host in hosts:
        out = out | F.contains(F.lower(value), F.lit(host))
    return out


def extract_website(
    text: Column | str,
    strict: bool = False,
    own_hosts: Sequence[str] = S.OWN_HOSTS,
    common_hosts: Sequence[str] = S.COMMON_HOSTS,
) -> Column:
    """``struct<text, website>``: the first URL, else the first bare host, and the text without them.

    The directory's own hosts are never a website and stay in the text, so that a footer naming one can still be
    cut. ``strict`` wants two dots in a bare host, skips the e-mail test and removes only what it accepts.
    """
    chains = F.lit(r"(?i)" + P.LATIN_LEFT_BOUND + P.HOST_CHAIN)
    of_chain = P.STRICT_HOST_OF_CHAIN if strict else P.HOST_OF_CHAIN

    def first_host(t: Column) -> Column:
        hosts = F.transform(F.regexp_extract_all(t, chains, F.lit(0)), lambda c: F.regexp_extract(c, of_chain, 1))
        found = F.coalesce(F.get(F.filter(hosts, lambda h: h != ""), F.lit(0)), F.lit(""))
        return F.when(F.contains(t, F.lit(".")), found).otherwise(F.when(t.isNotNull(), ""))

    def with_path(t: Column, host: Column) -> Column:
        """The host as it stands in the text with the path after it. No earlier place can hold it."""
        if strict:
            return host
        place = F.concat(F.lit(r"(?i)" + P.LATIN_LEFT_BOUND), quote(host), F.lit(P.HOST_PATH))
        return F.when(host != "", F.coalesce(F.regexp_substr(t, place), host)).otherwise(host)

    def from_url(t: Column) -> Column:
        def build(hit: Column) -> Column:
            url = F.rtrim(hit, F.lit(P.URL_TAIL))
            ok = (hit != "") & ~_names_host(url, own_hosts)
            drop = ok if strict else hit != ""
            return F.struct(
                F.when(drop, F.replace(t, hit, F.lit(""))).otherwise(t).alias("text"),
                F.when(ok, url).alias("website"),
            )

        return let(F.regexp_extract(t, P.URL_PATTERN, 0), build)

    def from_host(found: Column) -> Column:
        t, site = found["text"], found["website"]

        def build(whole: Column) -> Column:
            host = F.substring_index(whole, "/", 1)
            known = F.lower(host).isin(list(common_hosts))
            own = _names_host(host, own_hosts)
            if strict:
                ok = site.isNull() & (host != "") & ~own & ~known
                return F.struct(
                    F.when(ok, F.replace(t, whole, F.lit(""))).otherwise(t).alias("text"),
                    F.when(ok, F.concat(F.lit("https://"), host)).otherwise(site).alias("website"),
                )
            mail = F.regexp_like(t, F.concat(F.lit(r"(?i)(?<=[a-z0-9._%+-])@"), quote(host)))
            ok = (host != "") & ~own & ~known & ~mail
            cut = F.regexp_replace(t, F.concat(F.lit(r"(?i)" + P.LATIN_LEFT_BOUND), quote(whole)), F.lit(""))
            return F.struct(
                F.when((host != "") & ~own, cut).otherwise(t).alias("text"),
                F.coalesce(site, F.when(ok, F.concat(F.lit("https://"), whole))).alias("website"),
            )

        return let(first_host(t), lambda host: let(with_path(t, host), build))

    return let(col(text), lambda t: let(from_url(t), from_host))


def normalize_phone(phone: Column | str) -> Column:
    """``+7`` and ten digits, or null when the number is not a Russian one."""

    def build(digits: Column) -> Column:
        n = F.length(digits)
        full = (
            F.when((n == 11) & digits.startswith("8"), F.concat(F.lit("7"), F.substring(digits, 2, 10)))
            .when(n == 10, F.concat(F.lit("7"), digits))
            .otherwise(digits)
        )
        return F.when((F.length(full) == 11) & full.startswith("7"), F.concat(F.lit("+"), full))

    return let(F.regexp_replace(col(phone), r"\D", ""), build)


def extract_phones(text: Column | str, strip_raw: bool = False) -> Column:
    """``struct<text, phones>``: distinct normalised phones in order of search, and the text without them.

    Only numbers already written in the normal form leave the text; ``strip_raw`` removes them as written.
    """

    def build(t: Column) -> Column:
        raw = F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in P.PHONE_PATTERNS])

        def strip(hits: Column) -> Column:
            phones = F.array_distinct(F.filter(F.transform(hits, normalize_phone), lambda p: p.isNotNull()))
            drop = F.concat(hits, phones) if strip_raw else phones
            rest = F.aggregate(drop, t, lambda acc, p: F.replace(acc, p, F.lit("")))
            return F.struct(rest.alias("text"), phones.alias("phones"))

        return let(raw, strip)

    return let(col(text), build)


def tel_href(phone: Column | str) -> Column:
    """Dialable form: digits and plus only."""
    return F.regexp_replace(col(phone), r"[^\d+]", "")


def bare_url(url: Column | str) -> Column:
    return F.regexp_replace(col(url), r"^https?://", "")


def url_key(url: Column | str) -> Column:
    """Last path segment of a URL that ends with a slash."""
    return blank_to_null(F.regexp_extract(col(url), r"/([^/]+)/$", 1))


def url_number(url: Column | str) -> Column:
    """Number after the last underscore of a URL that ends with a slash."""
    return blank_to_null(F.regexp_extract(col(url), r"_(\d+)/$", 1))


def url_subdomain(url: Column | str, host: str = S.SUBDOMAIN_HOST) -> Column:
    """First label of the host when the rest of it is ``host``."""
    return blank_to_null(F.regexp_extract(col(url), rf"https?://([^.]+)\.{host.replace('.', chr(92) + '.')}", 1))


def is_block_page(title: Column | str, marks: Sequence[str] = S.BLOCK_WORDS) -> Column:
    """True for the title of an anti-bot page."""
    out = F.lit(False)
    for mark in marks:
        out = out | F.contains(col(title), F.lit(mark))
    return F.coalesce(out, F.lit(False))
