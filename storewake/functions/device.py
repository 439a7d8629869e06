"""Device columns from a user agent text, by an ordered list of patterns.

The default list covers the common browsers; a caller passes another list to
extend it. Every rule is a built-in regular expression, so no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from storewake.functions.values import text_or_null


@dataclass(frozen=True)
class AgentRule:
    """First rule whose pattern is found names the value; group 1 is the version."""

    name: str
    pattern: str


# Name and pattern, tried from the top.
BROWSERS = (
    AgentRule("Edge", r"Edg(?:e|A|iOS)?/([0-9.]+)"),
    AgentRule("Opera", r"(?:OPR|Opera)/([0-9.]+)"),
    AgentRule("Samsung Internet", r"SamsungBrowser/([0-9.]+)"),
    AgentRule("Mobile Chrome", r"Android.*Chrome/([0-9.]+) Mobile"),
    AgentRule("Mobile Chrome", r"CriOS/([0-9.]+)"),
    AgentRule("Mobile Firefox", r"FxiOS/([0-9.]+)"),
    AgentRule("Firefox", r"Firefox/([0-9.]+)"),
    AgentRule("Chrome", r"Chrome/([0-9.]+)"),
    AgentRule("Mobile Safari", r"(?:iPhone|iPad).*Version/([0-9.]+).*Safari/"),
    AgentRule("Safari", r"Version/([0-9.]+).*Safari/"),
)
SYSTEMS = (
    AgentRule("iOS", r"(?:iPhone|iPad).* OS ([0-9_]+)"),
    AgentRule("Android", r"Android ([0-9.]+)"),
    AgentRule("Windows", r"Windows NT ([0-9.]+)"),
    AgentRule("macOS", r"Mac OS X ([0-9_.]+)"),
    AgentRule("Chrome OS", r"CrOS [^ ]+ ([0-9.]+)"),
    AgentRule("Linux", r"Linux()"),
)
DEVICE_TYPES = (
    AgentRule("tablet", r"iPad|Tablet()"),
    AgentRule("mobile", r"iPhone|Android.*Mobile()"),
    AgentRule("tablet", r"Android()"),
)


def _name(agent: Column, rules: Sequence[AgentRule]) -> Column:
    result = F
    for rule in rules:
        result = result.when(agent.rlike(rule.pattern), rule.name)
    return result


def _version(agent: Column, rules: Sequence[AgentRule]) -> Column:
    result = F
    for rule in rules:
        result = result.when(agent.rlike(rule.pattern), F.regexp_extract(agent, rule.pattern, 1))
    return text_or_null(F.translate(result, "_", "."))


def device_struct(
    agent: Column,
    browsers: Sequence[AgentRule] = BROWSERS,
    systems: Sequence[AgentRule] = SYSTEMS,
    device_types: Sequence[AgentRule] = DEVICE_TYPES,
) -> Column:
    """os, os_version, browser, browser_version, device_type; null where nothing matches."""
    return F.struct(
        _name(agent, systems).alias("os"),
        _version(agent, systems).alias("os_version"),
        _name(agent, browsers).alias("browser"),
        _version(agent, browsers).alias("browser_version"),
        _name(agent, device_types).alias("device_type"),
    )
