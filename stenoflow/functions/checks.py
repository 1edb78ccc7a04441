"""Predicates and measures: network ranges, signal levels, values beyond limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clinic import DIASTOLIC, SYSTOLIC



PRESSURE = r"(?<![\d/])(\d{2,3})/(\d{2,3})(?![\d/])"


def ip_number(ip: Column) -> Column:
    """A dotted address as a number; null for anything else."""
    ok = ip.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$")
    part = lambda i: F.element_at(F.split(ip, r"\."), i).cast("long")
    return F.when(ok, part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4))


def in_network(ip: Column, network: str) -> Column:
    """P20: whether an address lies in a network a.b.c.d/n; null for what is no address."""
    base, _, bits = network.partition("/")
    start = sum(int(x) << s for x, s in zip(base.split("."), (24, 16, 8, 0)))
    span = 1 << (32 - int(bits or 32))
    return (ip_number(ip) >= start - start % span) & (ip_number(ip) < start - start % span + span)


def allowed(host: Column, hosts: list[str], networks: list[str]) -> Column:
    """P20: exact host names, addresses in the networks, and null (local calls) pass; all else is blocked."""
    ok = host.isNull() | host.isin(*hosts)
    for n in networks:
        ok = ok | F.coalesce(in_network(host, n), F.lit(False))
    return ok


def level_db(frame: Column) -> Column:
    """root mean square of a frame (array of samples) in decibels; an empty frame is -99."""
    energy = F.aggregate(frame, F.lit(0.0), lambda a, x: a + x * x) / F.nullif(F.size(frame), F.lit(0))
    return F.coalesce(20 * F.log10(F.sqrt(energy + 1e-12)), F.lit(-99.0))


def noise_gain(signal: Column, noise: Column, snr_db: Column) -> Column:
    """the factor for a noise frame that gives the wanted ratio of signal to noise."""
    return F.pow(F.lit(10.0), (level_db(signal) - level_db(noise) - snr_db) / 20)


def pressure_alerts(text: Column) -> Column:
    """the pressure readings of a text that are beyond the limits, as an array of texts."""
    readings = F.regexp_extract_all(text, F.lit(PRESSURE), 0)

    def beyond(r: Column) -> Column:
        high, low = F.split(r, "/")[0].cast("int"), F.split(r, "/")[1].cast("int")
        return ~high.between(*SYSTOLIC) | ~low.between(*DIASTOLIC)

    return F.filter(readings, beyond)
