"""Facts read from the client's user agent, screen size and element tags."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Substring -> label, in test order.
BROWSER_RULES = [("Chrome", "Chrome"), ("Firefox", "Firefox"), ("Safari", "Safari"), ("Edge", "Edge")]
OS_RULES = [
    ("Windows", "Windows"),
    ("Mac", "macOS"),
    ("Linux", "Linux"),
    ("Android", "Android"),
    ("iOS", "iOS"),
]
VERSION_PATTERN = r"(Chrome|Firefox|Safari|Edge)\/(\d+)"
UNKNOWN = "Unknown"

# Corrected order: the more specific marker is tested first.
BROWSER_RULES_CORRECTED = [
    ("Edg/", "Edge"),
    ("Edge/", "Edge"),
    ("Firefox", "Firefox"),
    ("Chrome", "Chrome"),
    ("Safari", "Safari"),
]
OS_RULES_CORRECTED = [
    ("iPhone", "iOS"),
    ("iPad", "iOS"),
    ("Android", "Android"),
    ("Windows", "Windows"),
    ("Mac", "macOS"),
    ("Linux", "Linux"),
]


def _first_marker(text: Column, rules: list[tuple[str, str]]) -> Column:
    label = None
    for marker, name in rules:
        test = text.contains(marker)
        label = F.when(test, name) if label is None else label.when(test, name)
    return label.otherwise(UNKNOWN)


def browser_name(user_agent: Column, corrected: bool = False) -> Column:
    return _first_marker(user_agent, BROWSER_RULES_CORRECTED if corrected else BROWSER_RULES)


def browser_version(user_agent: Column) -> Column:
    version = F.regexp_extract(user_agent, VERSION_PATTERN, 2)
    return F.when(version != "", version).otherwise(UNKNOWN)


def os_name(user_agent: Column, corrected: bool = False) -> Column:
    return _first_marker(user_agent, OS_RULES_CORRECTED if corrected else OS_RULES)


def screen_width(resolution: Column) -> Column:
    return F.try_element_at(F.split(resolution, "x"), F.lit(1)).cast("int")


def device_type(width: Column) -> Column:
    return F.when(width < 768, "mobile").when(width < 1024, "tablet").otherwise("desktop")


def tag_parts(tag: Column) -> tuple[Column, Column]:
    """``action:category`` tag; the category is NULL when there is no colon."""
    parts = F.split(tag, ":")
    return F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))


def visit_seconds(milliseconds: Column) -> Column:
    return F.floor(milliseconds / 1000).cast("int")


def execution_ms(seconds: Column) -> Column:
    return (seconds * 1000).cast("int")


def change_description(operation: Column, table: Column) -> Column:
    return F.concat(operation, F.lit(" operation on "), table)


def feature_description(feature: Column) -> Column:
    return F.concat(F.lit("Used feature: "), feature)


def error_description(kind: Column, message: Column) -> Column:
    return F.concat(kind, F.lit(": "), message)


def click_description(label: Column) -> Column:
    return F.concat(F.lit("Clicked on "), F.trim(label))
