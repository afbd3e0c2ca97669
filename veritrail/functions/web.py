"""Hosts, addresses and secrets."""

from __future__ import annotations

import ipaddress
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of fields whose values are secret, prefixes of tokens, and the shape of other tokens.
SECRET_KEY = "(?i)key|token|secret|password|authorization|credential"
SECRET_PREFIX = r"(sk-|AIza|ghp_|gho_|ghu_|ghs_|ghr_|xox[a-z]-)[A-Za-z0-9_\-]{6,}"
TOKEN_CHARS = r"^[A-Za-z0-9_\-]{20,}$"
REDACTED = "[REDACTED]"
#: Fields of an agent record that may be kept.
KEPT_FIELDS = (
    "action_id", "run_id", "campaign_id", "report_id", "model_name", "provider", "tier", "queries", "artifacts", "usage",
    "stop_reason", "n_findings", "n_rejected", "grounding_summary", "created_at",
)


def host(url: Column) -> Column:
    """The host in lower case, without user, port and final dot; null if there is none."""
    bare = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(bare, r"\.$", ""), F.lit(""))


def is_safe_url(url: Column) -> Column:
    """http or https, no user part, a named host, and the usual ports; addresses are judged by ``is_global``."""
    name, port = host(url), F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*:(\d+)(?:[/?#]|$)", 1)
    return F.coalesce(
        F.lower(url).rlike("^https?://") & ~url.rlike("^[A-Za-z]+://[^/?#]*@") & name.isNotNull() & (name != "localhost") & ~F.endswith(name, F.lit(".localhost")) & port.isin("", "80", "443"),
        F.lit(False),
    )


@F.pandas_udf(T.BooleanType())
def is_global(address: pd.Series) -> pd.Series:
    """Whether an IP address may be asked: public, and in none of the special ranges; what is no address may not."""

    def judge(text):
        try:
            ip = ipaddress.ip_address(text)
        except ValueError:
            return False
        ip = getattr(ip, "ipv4_mapped", None) or ip
        special = ip.is_multicast, ip.is_reserved, ip.is_unspecified, ip.is_loopback, ip.is_link_local, ip.is_private, getattr(ip, "is_site_local", False)
        return ip.is_global and not any(special)

    return address.map(judge, na_action="ignore")


def admissible(urls: DataFrame, hosts: DataFrame, url: str = "url") -> DataFrame:
    """urls with ``host`` and ``admissible``: the host or a domain above it is in hosts (host).

    Each host is expanded into its suffixes, which meet the list in an equi-join; a name that merely contains a
    listed one does not match. Distinct hosts are judged once.
    """
    named = urls.withColumn("host", host(F.col(url)))
    distinct = named.select("host").where("host IS NOT NULL").distinct()
    suffixes = F.transform(F.sequence(F.lit(1), F.size(F.split("host", r"\."))), lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k))
    good = distinct.select("host", F.explode(suffixes).alias("suffix")).join(hosts.select(F.lower("host").alias("suffix")).distinct(), "suffix", "left_semi").select("host").distinct()
    return named.join(good.withColumn("listed", F.lit(True)), "host", "left").withColumn("admissible", F.coalesce("listed", F.lit(False))).drop("listed")


def is_secret_key(name: Column) -> Column:
    return name.rlike(SECRET_KEY)


def is_secret_text(value: Column) -> Column:
    """A known prefix, or a long run of letters of both cases and digits."""
    return value.rlike(SECRET_PREFIX) | (value.rlike(TOKEN_CHARS) & value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]"))


def redacted_value(name: Column, value: Column) -> Column:
    """A flat field's value, or the mark where its name or shape tells of a secret."""
    return F.when(is_secret_key(name) | is_secret_text(value), F.lit(REDACTED)).otherwise(value)


def _scrub(value):
    import re

    if isinstance(value, dict):
        return {k: REDACTED if re.search(SECRET_KEY, k) else _scrub(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_scrub(v) for v in value]
    if isinstance(value, str):
        long = re.search(TOKEN_CHARS, value) and all(re.search(c, value) for c in ("[a-z]", "[A-Z]", "[0-9]"))
        return REDACTED if long or re.search(SECRET_PREFIX, value) else value
    return value


@F.pandas_udf(T.StringType())
def redacted_json(text: pd.Series) -> pd.Series:
    """JSON of any depth with secrets replaced; what is no JSON becomes null and never passes unread."""

    def clean(t):
        try:
            return json.dumps(_scrub(json.loads(t)), ensure_ascii=False)
        except ValueError:
            return None

    return text.map(clean, na_action="ignore")


def provenance(records: DataFrame) -> DataFrame:
    """Records with the fields that may be kept, strings redacted."""
    kept = [c for c in records.columns if c in KEPT_FIELDS]
    kinds = dict(records.dtypes)
    return records.select(*[redacted_value(F.lit(c), F.col(c)).alias(c) if kinds[c] == "string" else F.col(c) for c in kept])
