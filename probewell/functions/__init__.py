"""Column functions: URLs, compact identifiers, identities, property differences, tokens."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"
PLACEHOLDER = "CURATOR_REVIEW"


def compact_id_of_url(url: str, host: str = "identifiers.org") -> Column:
    """The compact identifier that a resolver URL asks for, or null for other URLs.

    If what follows the host holds a colon, only its path counts: query, fragment and parameters of the last segment go.
    """
    rest = F.regexp_extract(F.trim(url), rf"^https?://{host.replace('.', '[.]')}/(.*)$", 1)
    path = F.regexp_replace(F.regexp_replace(rest, r"[?#].*$", ""), r";[^/]*$", "")
    out = F.btrim(F.when(rest.contains(":"), path).otherwise(rest), F.lit("/"))
    return F.when(F.trim(url).rlike(rf"^https?://{host.replace('.', '[.]')}/"), out)


def without_namespace(lui: str, embedded: str) -> Column:
    """What follows the first colon where the namespace is embedded in the id, else the id."""
    return F.when(F.col(embedded), F.expr(f"substring({lui}, instr({lui}, ':') + 1)")).otherwise(F.col(lui))


def compact_id(prefix: str, lui: str, embedded: str) -> Column:
    return F.when(F.col(embedded), F.col(lui)).otherwise(F.concat(F.col(prefix), F.lit(":"), F.col(lui)))


def fill_pattern(pattern: str, lui: str) -> Column:
    return F.replace(F.col(pattern), F.lit("{$id}"), F.col(lui))


def lui_link(url, lui) -> Column:
    """The URL with the id as {$id}, everywhere; in angle brackets if the id isn't in it. Null stays null."""
    u, i = (F.col(c) if isinstance(c, str) else c for c in (url, lui))
    return F.when(u.contains(i), F.replace(u, i, F.lit("{$id}"))).otherwise(F.concat(F.lit("<"), u, F.lit(">")))


def without_scheme(url) -> Column:
    return F.regexp_replace(url, SCHEME, "")


def normalised_url(url: str) -> Column:
    """Without its fragment, then without one slash at the end."""
    return F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/$", "")


def scheme_class(url: str) -> Column:
    """http, ftp or unsupported: the client that a URL needs."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.when(scheme.isin("http", "https"), "http").when(scheme == "ftp", "ftp").otherwise("unsupported")


def final_hop(redirects: str = "redirects") -> Column:
    return F.try_element_at(redirects, F.lit(-1))


def http_status(status: str, timed_out: str) -> Column:
    """204 stands for a request without an answer: 408 where it timed out, else unknown."""
    return F.when(F.col(status) == 204, F.when(F.col(timed_out), 408)).otherwise(F.col(status))


def milliseconds(seconds: str) -> Column:
    """Seconds rounded to three digits, times 1000, cut to an integer."""
    return (F.round(seconds, 3) * 1000).cast("int")


def ftp_outcome(code: str, message: str) -> Column:
    """(status, dns_error, invalid_response) of an FTP probe: its code or 200; after a failure the code in the message."""
    found = F.regexp_extract(F.coalesce(message, F.lit("")), r"[1-6]\d\d", 0).try_cast("int")
    failed = F.col(message).isNotNull()
    status = F.when(failed, F.when(found == 115, 408).otherwise(found)).otherwise(F.coalesce(code, F.lit(200)))
    return F.struct(status.alias("status"), (failed & F.coalesce(status == 434, F.lit(False))).alias("dns_error"), failed.alias("invalid_response"))


def hop_flags(headers) -> Column:
    """(dns_error, ssl_error, invalid_response) of a hop's map of headers: whether the probe's mark for it is there and not empty."""
    has = lambda name: (F.coalesce(F.length(F.try_element_at(headers, F.lit(f"x-{name.replace('_', '-')}"))), F.lit(0)) > 0).alias(name)
    return F.struct(*map(has, ("dns_error", "ssl_error", "invalid_response")))


def ip_port(ip, port) -> Column:
    """ip:port as text, an IPv6 address in brackets; null without an address."""
    i = F.col(ip) if isinstance(ip, str) else ip
    p = F.col(port) if isinstance(port, str) else port
    return F.concat(F.when(i.contains(":"), F.concat(F.lit("["), i, F.lit("]"))).otherwise(i), F.coalesce(F.concat(F.lit(":"), p.cast("string")), F.lit("")))


def wrapped(kind, value) -> Column:
    """Addresses (homeUrl, rorId) in angle brackets, as reports show them; other properties as they are."""
    return F.when(kind.isin("homeUrl", "rorId"), F.concat(F.lit("<"), value, F.lit(">"))).otherwise(value)


def timeout_hops(url: str, limit_ms: str) -> Column:
    """The one hop of a probe that ran out of time."""
    no = F.lit(False)
    return F.array(F.struct(F.col(url).alias("url"), F.lit(None).cast("string").alias("ip_port"), F.col(limit_ms).cast("int").alias("response_time"), F.lit(408).alias("status"), no.alias("dns_error"), no.alias("ssl_error"), no.alias("invalid_response")))


def placeholder_to_null(value) -> Column:
    return F.nullif(value, F.lit(PLACEHOLDER))


def resource_label(provider_code: str, mir_id: str, prefix: str) -> Column:
    return F.concat(F.coalesce(placeholder_to_null(F.col(provider_code)), F.col(mir_id)), F.lit("/"), F.col(prefix))


def registry_link(provider_code: str, mir_id: str, prefix: str) -> Column:
    """A resource as reports name it, with the address of its namespace in the registry."""
    return F.concat(F.lit("["), resource_label(provider_code, mir_id, prefix), F.lit("](https://registry.identifiers.org/registry/"), F.col(prefix), F.lit(")"))


def ror_url(ror_id: str) -> Column:
    return F.concat(F.lit("https://ror.org/"), F.col(ror_id))


def percent(x) -> Column:
    """One digit after the point, no separators of thousands."""
    return F.format_string("%.1f%%", x * 100)


def ascii_json(text) -> Column:
    """JSON with all code points but printable ASCII as \\u escapes of four lower-case digits, those beyond U+FFFF as two: so keys are
    written the same whatever wrote them."""
    t = F.col(text) if isinstance(text, str) else text
    escape = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def escaped(c):
        n = F.ascii(c)
        pair = F.concat(escape(F.shiftright(n - 0x10000, 10) + 0xD800), escape((n - 0x10000).bitwiseAND(0x3FF) + 0xDC00))
        return F.when(n > 0xFFFF, pair).when(n > 0x7E, escape(n)).otherwise(c)

    # Escapes that are there already (control characters, in upper case), other escaped characters, runs of ASCII, and single code points.
    parts = F.regexp_extract_all(t, F.lit(r"(?s)\\u[0-9A-Fa-f]{4}|\\.|[ -\[\]-~]+|."), F.lit(0))
    whole = F.array_join(F.transform(parts, lambda c: F.when(c.startswith("\\u"), F.lower(c)).otherwise(escaped(c))), "")
    return F.when(t.rlike(r"[^ -~]|\\u"), whole).otherwise(t)


def canonical_json(struct) -> Column:
    """A struct (its fields in alphabetical order) as the JSON under which issues are tagged: no spaces, ASCII only."""
    return ascii_json(F.to_json(struct))


def identity(kind: str, **fields) -> Column:
    """Canonical JSON with sorted keys: the key under which an issue is tagged."""
    cols = {"type": F.lit(kind), **fields}
    return canonical_json(F.struct(*[cols[k].alias(k) for k in sorted(cols)]))


def identity_type(column: str) -> Column:
    return F.coalesce(F.get_json_object(column, "$.type"), F.lit("Unidentified"))


def words(column) -> Column:
    """Lower-case words, split where no word character stands; empty ones are left out."""
    return F.filter(F.split(F.lower(column), r"(?U)\W+"), lambda w: w != "")


def bare_address(url) -> Column:
    """An address for comparison: without its scheme, all slashes at its end, and an empty query or fragment."""
    c = F.regexp_replace(url, "/+$", "")
    c = F.regexp_replace(F.regexp_replace(c, "#$", ""), r"^([^?#]*)[?](?=#|$)", "$1")
    return without_scheme(c)


def property_verdict(kind: str, old: str, new: str, single) -> Column:
    """MISSING, ADD, KEEP, REPLACE or SAME for a property of a registry entry against a linked entity.

    Addresses that differ in scheme or last slashes are kept; so is a description if there is only one entity.
    """
    o, n, k = F.col(old).cast("string"), F.col(new).cast("string"), F.col(kind)
    keep = ((k == "homeUrl") & (bare_address(o) == bare_address(n))) | ((k == "description") & single)
    return F.when(o.isNull() & n.isNull(), "MISSING").when(o.isNull(), "ADD").when(n.isNull(), "KEEP").when(o == n, "SAME").when(keep, "KEEP").otherwise("REPLACE")


# ---- tokens -------------------------------------------------------------------------------------------------------

INLINE_TAGS = "a|abbr|b|bdi|bdo|big|cite|code|em|font|i|kbd|mark|q|s|samp|small|span|strike|strong|sub|sup|tt|u|var"
# Fixed value: the characters that an address is taken to hold.
URL = r"(?<![A-Za-z0-9_])(?:http|ftp)s?://(?:[a-zA-Z0-9$-_@.&+#!*(),]|%[0-9a-fA-F]{2})+(?![A-Za-z0-9_])"
# Fixed value: what a token is.
TOKEN = r"(?U)(?:\w+[-'.+:])*\w+"


# Row by row: Spark hands a hundred texts at a time to Python, where an Arrow batch has ten thousand.
@F.udf(StringType(), useArrow=False)
def _unescaped(text: str | None) -> str | None:
    return None if text is None else html.unescape(text)


def markup_text(column) -> Column:
    """Text of markup: scripts, styles, comments and tags go. Block tags part words, inline tags don't. Character references, named
    and numbered, are decoded in texts that hold some."""
    c = F.regexp_replace(column, r"(?is)<(script|style)\b.*?(</\1\s*>|$)", " ")
    c = F.regexp_replace(c, r"(?s)<!--.*?(-->|$)", " ")
    c = F.regexp_replace(c, rf"(?i)</?(?:{INLINE_TAGS})(?:\s[^<>]*)?/?>", "")
    c = F.regexp_replace(c, r"(?s)</?[A-Za-z!?][^<>]*>", " ")
    return F.when(c.rlike("&#?[A-Za-z0-9]"), _unescaped(c)).otherwise(c)


def json_values(text: str) -> str:
    """text with each JSON value in it replaced by its values, keys left out. What isn't JSON stays."""
    decoder, out, at = json.JSONDecoder(), [], 0

    def values(v):
        if isinstance(v, dict):
            for k in sorted(v):
                yield from values(v[k])
        elif isinstance(v, list):
            for x in v:
                yield from values(x)
        else:
            yield str(v)

    while at < len(text):
        start = min((i for i in (text.find("{", at), text.find("[", at)) if i >= 0), default=-1)
        if start < 0:
            break
        out.append(text[at:start])
        try:
            v, at = decoder.raw_decode(text, start)
            out.append(" " + " ".join(values(v)) + " ")
        except (ValueError, RecursionError):
            out.append(text[start])
            at = start + 1
    return "".join([*out, text[at:]])


@F.udf(StringType(), useArrow=False)
def _inline_json(text: str | None) -> str | None:
    return None if text is None else json_values(text)


def exclusion_forms(lui) -> Column:
    """What is taken out of a text for an id: the id, and for one with # also what precedes it, and its first letters and digits."""
    more = F.when(lui.contains("#"), F.array(lui, F.substring_index(lui, "#", 1), F.regexp_extract(lui, "^[A-Za-z0-9]*", 0))).otherwise(F.array(lui))
    return F.array_distinct(F.filter(more, lambda x: x.isNotNull() & (x != "")))


def pattern_of_forms(forms) -> Column:
    """One pattern for the forms (array), longest first; null for none."""
    ordered = F.transform(F.sort_array(F.transform(F.array_distinct(forms), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda s: F.concat(F.lit(r"\Q"), F.replace(s.x, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    return F.when(F.size(ordered) > 0, F.concat(F.lit(r"(?<![A-Za-z0-9_])(?:"), F.array_join(ordered, "|"), F.lit(r")(?![A-Za-z0-9_])")))


def exclusion_pattern(ids) -> Column:
    """One pattern for the forms of a provider's ids (array)."""
    return pattern_of_forms(F.flatten(F.transform(ids, exclusion_forms)))


def plain_tokens(column) -> Column:
    """Lower-case tokens of plain text: word characters, joined by single - ' . + : between them."""
    return F.transform(F.regexp_extract_all(column, F.lit(TOKEN), F.lit(0)), lambda t: F.lower(t))


def plain_text(content) -> Column:
    """Markup to text, inline JSON to values."""
    c = markup_text(F.col(content) if isinstance(content, str) else content)
    return F.when(c.rlike(r"[{\[]"), _inline_json(c)).otherwise(c)


def tokens_of_text(text, exclusions: Column | None = None) -> Column:
    """Addresses and exclusions (a pattern) deleted, then plain_tokens."""
    c = F.col(text) if isinstance(text, str) else text
    pattern = F.lit(f"(?i){URL}") if exclusions is None else F.when(exclusions.isNull(), F.lit(f"(?i){URL}")).otherwise(F.concat(F.lit(f"(?i:{URL})|(?i:"), exclusions, F.lit(")")))
    return plain_tokens(F.regexp_replace(c, pattern, F.lit("")))


def tokens(content: str, exclusions: Column | None = None) -> Column:
    """Markup to text, inline JSON to values, addresses and exclusions deleted, then plain_tokens."""
    return tokens_of_text(plain_text(content), exclusions)
