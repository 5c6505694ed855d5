"""Hosts and labels as Column expressions. All of them give null for null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LABEL = "^[a-z0-9]([a-z0-9-]*[a-z0-9])?$"


def ws_strip(x: Column) -> Column:
    """Without Unicode white space at both ends (``trim`` knows spaces only)."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def or_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def normalize_host(x: Column) -> Column:
    """Stripped, lower case, without dots at the ends; null when nothing is left."""
    return or_null(F.trim(F.lower(ws_strip(x)), F.lit(".")))


def strip_port(host: Column) -> Column:
    return F.substring_index(host, ":", 1)


def short_hostname(x: Column) -> Column:
    """The first label in lower case; '' for null or nothing."""
    bare = F.regexp_replace(ws_strip(x), r"\.+$", "")
    return F.coalesce(F.lower(F.substring_index(bare, ".", 1)), F.lit(""))


def short_hostnames(xs: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(xs, short_hostname), lambda s: s != ""))


def labels(host: Column) -> Column:
    return F.split(host, "[.]")


def reverse_labels(host: Column) -> Column:
    """www.example.com -> com.example.www"""
    return F.array_join(F.reverse(labels(host)), ".")


def ancestors(host: Column) -> Column:
    """The host and all its parents, from the host outward."""
    whole = lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), "."))
    return F.get(F.transform(F.array(labels(host)), whole), F.lit(0))  # in a list of one, so that the host is split once


def probes(host: Column) -> Column:
    """Each ancestor, then the wildcard on it, from the host outward."""
    return F.flatten(F.transform(ancestors(host), lambda c: F.array(c, F.concat(F.lit("*."), c))))


def naive_domain(host: Column) -> Column:
    """The last two labels; null without a dot."""
    return F.when(F.contains(host, F.lit(".")), F.substring_index(host, ".", -2))


def tld(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def response_code(x: Column) -> Column:
    return or_null(F.upper(ws_strip(x)))


def under_domain(host: Column, domain: Column) -> Column:
    """Equal, or below it at a label's border."""
    return (host == domain) | F.endswith(host, F.concat(F.lit("."), domain))


def valid_host(host: Column) -> Column:
    """Labels of letters, digits and inner hyphens; with a dot, or a wildcard.

    Tested label by label: one pattern for all would recurse by label.
    """
    body = F.regexp_replace(host, r"^\*\.", "")
    return (F.startswith(host, F.lit("*.")) | F.contains(host, F.lit("."))) & F.forall(labels(body), lambda x: x.rlike(LABEL))


def direction(network_direction: Column) -> Column:
    """query for inbound or ingress, reply for outbound or egress, else null."""
    return F.when(network_direction.isin("inbound", "ingress"), "query").when(network_direction.isin("outbound", "egress"), "reply")
