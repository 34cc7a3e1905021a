"""Scalar column expressions. All are built-in Spark expressions (codegen'd)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens import constants as K


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# -- packets and flows -------------------------------------------------------

def service_of_port(port, proto=None) -> Column:
    """Destination port -> service name; ICMP is ``eco_i``."""
    port = _c(port)
    expr = F.lit(K.DEFAULT_SERVICE)
    for p, name in reversed(list(K.PORT_SERVICE.items())):
        expr = F.when(port == F.lit(p), F.lit(name)).otherwise(expr)
    if proto is not None:
        expr = F.when(_c(proto) == F.lit("icmp"), F.lit(K.ICMP_SERVICE)).otherwise(expr)
    return expr


def protocol_tag(has_tcp, has_udp, has_icmp) -> Column:
    """Protocol tag in the order tcp, udp, icmp, other."""
    return (F.when(_c(has_tcp), "tcp").when(_c(has_udp), "udp")
            .when(_c(has_icmp), "icmp").otherwise("other"))


def endpoint(ip, port) -> Column:
    """``ip:port`` text used for the direction-free flow key."""
    return F.concat_ws(":", _c(ip), _c(port).cast("string"))


def flow_key_low(ip_src, port_src, ip_dst, port_dst) -> Column:
    """Lexically smaller endpoint (string order, not numeric)."""
    return F.least(endpoint(ip_src, port_src), endpoint(ip_dst, port_dst))


def flow_key_high(ip_src, port_src, ip_dst, port_dst) -> Column:
    return F.greatest(endpoint(ip_src, port_src), endpoint(ip_dst, port_dst))


def payload_text(payload) -> Column:
    """Payload decoded as UTF-8 with bad bytes dropped, lower-cased."""
    p = _c(payload)
    text = F.make_valid_utf8(p.cast("string"))
    # invalid sequences come back as U+FFFD; drop them as a lenient decoder does
    text = F.regexp_replace(text, "�", "")
    return F.lower(text)


def contains_any(text, markers) -> Column:
    t = _c(text)
    return reduce(lambda a, b: a | b, [t.contains(m) for m in markers])


def failed_login_hit(payload) -> Column:
    """1 when a packet carries any failed-login marker (counts once per packet)."""
    return F.when(contains_any(payload_text(payload), K.FAILED_LOGIN_MARKERS), 1).otherwise(0)


def guest_login_hit(payload) -> Column:
    """1 when a packet carries any guest-login marker."""
    return F.when(contains_any(payload_text(payload), K.GUEST_LOGIN_MARKERS), 1).otherwise(0)


def tcp_flag_class(proto, has_s, has_f, has_r, has_a) -> Column:
    """P10: ordered rules over the set of TCP flag letters seen in a flow.

    S and F -> SF; S and R -> REJ; S with none of A, F, R -> S0; R -> RSTR;
    otherwise SF. Non-TCP flows are SF.
    """
    s, f, r, a = _c(has_s), _c(has_f), _c(has_r), _c(has_a)
    rule = (F.when(s & f, "SF").when(s & r, "REJ")
            .when(s & ~(a | f | r), "S0").when(r, "RSTR").otherwise("SF"))
    return F.when(_c(proto) == "tcp", rule).otherwise("SF")


# -- labels ------------------------------------------------------------------

def clean_label(label) -> Column:
    """Label as text with '.' stripped at both ends."""
    return F.expr(f"trim(BOTH '.' FROM cast({_sql_ref(label)} as string))")


def _sql_ref(col) -> str:
    if isinstance(col, str):
        return f"`{col}`"
    raise TypeError("clean_label takes a column name")


def attack_category_map() -> Column:
    """P3 as a literal map (40 entries)."""
    items = []
    for k, v in K.ATTACK_CATEGORY.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def label_category(label) -> Column:
    """P2 + P3: raw attack name -> category, default ``unknown`` (null too)."""
    return F.coalesce(F.element_at(attack_category_map(), clean_label(label)),
                      F.lit(K.UNKNOWN_CATEGORY))


# -- scoring and alerts ------------------------------------------------------

def is_threat(prediction) -> Column:
    """``lower(pred)`` not in (normal, 0)."""
    return ~F.lower(_c(prediction)).isin(*K.NORMAL_PREDICTIONS)


def severity(prediction, confidence) -> Column:
    """P20: red when malicious and confidence > 0.9 (strict), yellow when malicious, else green."""
    mal = is_threat(prediction)
    return (F.when(mal & (_c(confidence) > F.lit(K.HIGH_CONFIDENCE)), "red")
            .when(mal, "yellow").otherwise("green"))


def display_label(prediction) -> Column:
    """``DETECTED: <UPPER>`` for threats, ``NORMAL_TRAFFIC`` otherwise."""
    return F.when(is_threat(prediction),
                  F.concat(F.lit("DETECTED: "), F.upper(_c(prediction)))).otherwise("NORMAL_TRAFFIC")


def threat_class(prediction) -> Column:
    """MALICIOUS / NORMAL class of a row for the class filter."""
    return F.when(is_threat(prediction), "MALICIOUS").otherwise("NORMAL")


def ip_search_text(src_ip, dst_ip, node_ip) -> Column:
    """The text searched by the IP filter, ``src dst node``."""
    return F.concat_ws(" ", _c(src_ip), _c(dst_ip), _c(node_ip))


def ip_matches(src_ip, dst_ip, node_ip, query: str) -> Column:
    """Case-insensitive substring match; an empty query matches all."""
    if query == "":
        return F.lit(True)
    return F.lower(ip_search_text(src_ip, dst_ip, node_ip)).contains(query.lower())


def percent_text(confidence) -> Column:
    """Confidence as a percent with one decimal (e.g. ``93.5``)."""
    return F.format_number(_c(confidence) * 100.0, 1)


def impact_text(value) -> Column:
    """Impact with two decimals."""
    return F.format_number(_c(value), 2)


def alert_id(*cols) -> Column:
    """P25: 8 hex characters. Derived from the alert's content so a retried
    task produces the same id (the source uses random bytes)."""
    return F.substring(F.sha2(F.concat_ws("|", *[_c(c).cast("string") for c in cols]), 256), 1, 8)


def timestamp_text(ts) -> Column:
    """``yyyy-MM-dd HH:mm:ss``."""
    return F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss")


# -- time without the session time zone ----------------------------------------

def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def micros_between(start, end) -> Column:
    """Microseconds from ``start`` to ``end`` (TIMESTAMP_NTZ), independent of
    the session time zone (no DST shifts)."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end))


def ntz_to_event_time(ts) -> Column:
    """TIMESTAMP_NTZ → TIMESTAMP with the same wall-clock reading in UTC, for
    watermarks and windows; independent of the session time zone."""
    return F.timestamp_micros(micros_between(_epoch(), ts))


def event_time_to_ntz(ts) -> Column:
    """Inverse of ``ntz_to_event_time``."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(_c(ts)), _epoch())
