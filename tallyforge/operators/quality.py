"""Declared constraints as table checks. Each result is one small row per rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyforge.sources.schemas import ENUMS, FOREIGN_KEYS, LENGTHS, UNIQUE_KEYS, schema_of

# Registration rules.
MIN_NAME_LENGTH = 2
MIN_USERNAME_LENGTH = 3
USERNAME_PATTERN = r"^[a-zA-Z0-9_]+$"
EMAIL_PATTERN = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"


def _stack(frames: list[DataFrame]) -> DataFrame:
    """All rows of frames with the same columns in the same order."""
    return reduce(DataFrame.union, frames)


def _key_text(columns: list[str]) -> str:
    """SQL of one text for the values of a key; NULL counts as a value, and no two keys share a text."""
    texts = [f"CAST(`{c}` AS STRING)" for c in columns]
    return texts[0] if len(texts) == 1 else "concat(" + ", ".join(f"coalesce(concat(length({t}), ':', {t}), '-')" for t in texts) + ")"


def _tagged(frame: DataFrame, parts: list[tuple[dict[str, int], str]]) -> DataFrame:
    """Each row once for each part: its numbers, and ``key``. SQL text, since many expressions from Python take their time."""
    listed = [
        "named_struct(" + ", ".join(f"'{name}', {number}" for name, number in numbers.items()) + f", 'key', {text})" for numbers, text in parts
    ]
    return frame.selectExpr(f"inline(array({', '.join(listed)}))")


def duplicate_keys(tables: dict[str, tuple[DataFrame, list[str] | list[list[str]]]]) -> DataFrame:
    """Per table and key (one, or a list of several): how many keys repeat, and the rows beyond the first.

    A table is read once with all its keys, and all keys of all tables are counted in one shuffle, equal ones added up before it.
    """
    several = {name: (df, keys if isinstance(keys[0], list) else [keys]) for name, (df, keys) in tables.items()}
    rules = [(name, key) for name, (_, keys) in several.items() for key in keys]
    stacks = []
    for name, (df, keys) in several.items():
        stacks.append(_tagged(df, [({"rule": rules.index((name, key))}, _key_text(key)) for key in keys]))
    counted = _stack(stacks).groupBy("rule", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sums = counted.groupBy("rule").agg(F.count(F.lit(1)).alias("duplicate_keys"), F.sum(F.col("n") - 1).alias("extra_rows"))
    return _every_rule(sums, [{"table_name": name, "key_columns": ",".join(key)} for name, key in rules], ["duplicate_keys", "extra_rows"])


def _every_rule(found: DataFrame, rules: list[dict[str, str]], counts: list[str]) -> DataFrame:
    """A row for each rule, zeros where ``found`` (``rule`` and ``counts``) has none."""
    each = ", ".join(f"max(CASE WHEN rule = {n} THEN struct({', '.join(counts)}) END) AS r{n}" for n in range(len(rules)))
    named = [
        "named_struct("
        + ", ".join([f"'{name}', '{text}'" for name, text in rule.items()] + [f"'{c}', coalesce(r{n}.{c}, 0L)" for c in counts])
        + ")"
        for n, rule in enumerate(rules)
    ]
    struct = found.selectExpr(f"struct({each}) AS seen").select("seen.*")
    return struct.selectExpr(f"inline(array({', '.join(named)}))")


def orphans(links: list[tuple[str, DataFrame, str, str, DataFrame, str]]) -> DataFrame:
    """Child keys without a parent.

    Each child is read once with all its references, each parent once with all keys that are referred to; keys are counted
    before they are shuffled and meet in one anti join for all links. Keys are compared as text. A link without orphans has zeros.
    """
    parents: dict[tuple[str, str], DataFrame] = {}
    children: dict[str, tuple[DataFrame, list[tuple[int, str, int]]]] = {}
    for number, (child_name, child, column, parent_name, parent, parent_column) in enumerate(links):
        parents.setdefault((parent_name, parent_column), parent)
        target = list(parents).index((parent_name, parent_column))
        children.setdefault(child_name, (child, []))[1].append((number, column, target))

    def stacked(frame: DataFrame, parts: list[tuple[dict[str, int], str]]) -> DataFrame:
        return _tagged(frame, [(numbers, _key_text([column])) for numbers, column in parts]).filter("key IS NOT NULL")

    links_of = {name: (frame, [({"link": n, "parent": t}, c) for n, c, t in parts]) for name, (frame, parts) in children.items()}
    asked = _stack([stacked(*of) for of in links_of.values()]).groupBy("link", "parent", "key").agg(F.count(F.lit(1)).alias("n"))
    by_table: dict[str, list[tuple[dict[str, int], str]]] = {}
    for target, (name, column) in enumerate(parents):
        by_table.setdefault(name, []).append(({"parent": target}, column))
    frames = {name: frame for (name, _), frame in parents.items()}
    held = _stack([stacked(frames[name], parts) for name, parts in by_table.items()])
    lost = asked.join(held, ["parent", "key"], "left_anti").groupBy(F.col("link").alias("rule"))
    sums = lost.agg(F.count(F.lit(1)).alias("orphan_keys"), F.sum("n").alias("orphan_rows"))
    rules = [{"child": child, "child_column": column, "parent": parent} for child, _, column, parent, _, _ in links]
    return _every_rule(sums, rules, ["orphan_keys", "orphan_rows"])


def enum_violations(tables: list[tuple[str, DataFrame, str, list[str]]]) -> DataFrame:
    """Values outside an enum's domain, with their counts."""
    return _stack(
        [
            df.filter(~F.col(column).isin(*domain))
            .groupBy(F.col(column).alias("value"))
            .agg(F.count(F.lit(1)).alias("row_count"))
            .select(F.lit(name).alias("table_name"), F.lit(column).alias("column_name"), "value", "row_count")
            for name, df, column, domain in tables
        ]
    )


def null_and_length(name: str, df: DataFrame, rules: dict[str, tuple[bool, int | None]]) -> DataFrame:
    """NOT NULL and length violations of many columns in one pass.

    ``rules``: column -> (required, longest length or None).
    """
    checks = []
    for column, (required, longest) in rules.items():
        missing = F.count_if(F.col(column).isNull()) if required else F.lit(0).cast("long")
        too_long = F.count_if(F.length(F.col(column)) > longest) if longest else F.lit(0).cast("long")
        checks.append(
            F.struct(
                F.lit(name).alias("table_name"),
                F.lit(column).alias("column_name"),
                missing.alias("null_rows"),
                too_long.alias("too_long_rows"),
            )
        )
    return df.agg(F.array(*checks).alias("checks")).select(F.inline("checks"))


def declared_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """Duplicates of every declared key, and of ``id``, that the tables at hand have."""
    held = {
        name: (frame, [keys for keys in [["id"], *UNIQUE_KEYS.get(name, [])] if set(keys) <= set(frame.columns)])
        for name, frame in tables.items()
    }
    return duplicate_keys({name: (frame, keys) for name, (frame, keys) in held.items() if keys})


def declared_links(tables: dict[str, DataFrame]) -> DataFrame:
    """Orphans of every declared reference between the tables at hand."""
    links = [
        (child, tables[child], column, parent, tables[parent], parent_column)
        for child, column, parent, parent_column, _ in FOREIGN_KEYS
        if child in tables and parent in tables and column in tables[child].columns and parent_column in tables[parent].columns
    ]
    return orphans(links)


def declared_domains(tables: dict[str, DataFrame]) -> DataFrame:
    """Values outside every declared enum."""
    return enum_violations(
        [(t, tables[t], column, domain) for (t, column), domain in ENUMS.items() if t in tables and column in tables[t].columns]
    )


def declared_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """NULLs in required columns and texts beyond their declared length, one pass a table."""
    checks = []
    for name, frame in tables.items():
        lengths = LENGTHS.get(name, {})
        rules = {
            field.name: (not field.nullable, lengths.get(field.name))
            for field in schema_of(name)
            if field.name in frame.columns and (not field.nullable or field.name in lengths)
        }
        if rules:
            checks.append(null_and_length(name, frame, rules))
    return _stack(checks)


def _broken(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(True))


def registration_violations(users: DataFrame) -> DataFrame:
    """One row per broken rule; an absent field breaks its rule."""
    username, email = F.trim("username"), F.trim("email")
    short_username = F.coalesce(F.length(username), F.lit(0)) < MIN_USERNAME_LENGTH
    rules = [
        ("first_name", F.length(F.trim("first_name")) < MIN_NAME_LENGTH, "too short"),
        ("last_name", F.length(F.trim("last_name")) < MIN_NAME_LENGTH, "too short"),
        ("username", short_username, "too short"),
        ("username", ~short_username & ~username.rlike(USERNAME_PATTERN), "invalid characters"),
        ("email", ~email.rlike(EMAIL_PATTERN), "invalid address"),
    ]
    flags = [
        F.when(_broken(test), F.struct(F.lit(field).alias("field"), F.lit(text).alias("violation")))
        for field, test, text in rules
    ]
    return users.select("id", F.inline(F.filter(F.array(*flags), lambda v: v.isNotNull())))
