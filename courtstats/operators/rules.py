"""Ordered rename rules as data: the first rule that matches a name decides.

A rule has a pattern (the whole name, a part of it, or a regular expression), a
replacement (none: the name is kept) and a suffix that is added.  Rules are matched
against the distinct names of a column, not against its rows, and only names that a
rule changes are joined back.  ``report`` lists the names that several rules or none
match, and the rules that match no name, so that a table of overrides can be kept in order."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("equals", "contains", "regex")
#: rules are expressions of one projection; keep tables beyond this in a join of their own
MAX_RULES = 1_000


@dataclass(frozen=True)
class Rule:
    pattern: str
    replacement: str | None = None
    suffix: str = ""
    kind: str = "contains"

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"rule kind {self.kind!r} is none of {KINDS}")
        if self.kind == "regex":
            re.compile(self.pattern)


SCHEMA = "rule int, kind string, pattern string, replacement string, suffix string"


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The rules as a table (to be stored and edited); ``rule`` is their order."""
    return spark.createDataFrame([(i, r.kind, r.pattern, r.replacement, r.suffix) for i, r in enumerate(rules)], SCHEMA)


def _listed(rules) -> list[Rule]:
    if isinstance(rules, DataFrame):
        rows = rules.orderBy("rule").limit(MAX_RULES + 1).collect()
        rules = [Rule(r.pattern, r.replacement, r.suffix or "", r.kind) for r in rows]
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    return list(rules)


def _matches(name: Column, rule: Rule) -> Column:
    if rule.kind == "equals":
        return name == rule.pattern
    return name.contains(rule.pattern) if rule.kind == "contains" else name.rlike(rule.pattern)


def resolve(names: DataFrame, col: str, rules) -> DataFrame:
    """``names`` with ``rules`` (array of the numbers of the matching rules, in order) and
    ``resolved`` (the name that the first of them gives; the name itself without one)."""
    rules = _listed(rules)
    name = F.col(col)
    if not rules:
        return names.withColumns({"rules": F.array().cast("array<int>"), "resolved": name})
    hits = F.array_compact(F.array(*[F.when(_matches(name, r), F.lit(i)) for i, r in enumerate(rules)]))
    d = names.withColumn("rules", F.coalesce(hits, F.array().cast("array<int>")))
    first = F.get("rules", F.lit(0))
    new = F.get(F.array(*[F.lit(r.replacement).cast("string") for r in rules]), first)
    tail = F.get(F.array(*[F.lit(r.suffix or "") for r in rules]), first)
    return d.withColumn("resolved", F.when(first.isNull(), name).otherwise(F.concat(F.coalesce(new, name), tail)))


def apply_rules(df: DataFrame, col: str, rules, name: str | None = None) -> DataFrame:
    """``df`` with ``col`` (or a new column ``name``) renamed by the rules.  Missing names
    stay missing.  Rules on whole names change at most as many names as there are
    rules, so those are broadcast; others are joined."""
    rules = _listed(rules)
    changed = resolve(df.select(col).distinct().filter(F.col(col).isNotNull()), col, rules).filter(F.size("rules") > 0)
    changed = changed.select(F.col(col).alias("_rule_key"), F.col("resolved").alias("_rule_new"))
    if all(r.kind == "equals" for r in rules):
        changed = F.broadcast(changed)
    out = df.join(changed, df[col] == changed["_rule_key"], "left") if rules else df.withColumn("_rule_new", F.lit(None).cast("string"))
    return out.withColumn(name or col, F.coalesce("_rule_new", col)).drop("_rule_key", "_rule_new")


def report(df: DataFrame, col: str, rules) -> DataFrame:
    """status, name, rules: ``several`` and ``none`` for names by the rules that match,
    ``unused`` for rules without a name."""
    rules = _listed(rules)
    r = resolve(df.select(F.col(col).alias("name")).distinct().filter(F.col("name").isNotNull()), "name", rules)
    odd = r.filter(F.size("rules") != 1).select(F.when(F.size("rules") > 1, "several").otherwise("none").alias("status"), "name", "rules")
    used = r.select(F.explode("rules").alias("rule")).distinct()
    every = df.sparkSession.range(len(rules)).select(F.col("id").cast("int").alias("rule"))
    unused = every.join(used, "rule", "left_anti").select(
        F.lit("unused").alias("status"), F.lit(None).cast("string").alias("name"), F.array("rule").alias("rules"))
    return odd.unionByName(unused)


def _contain(pairs: list[tuple[str, str]]) -> list[Rule]:
    return [Rule(p, new) for p, new in pairs]


# Contract names and the names of the statistics tables.
CONTRACT_RULES = [Rule(n, suffix=" Jr.", kind="equals") for n in (
    "Troy Brown", "Vernon Carey", "Tim Hardaway", "Larry Nance", "Michael Porter",
    "Dennis Smith", "Kelly Oubre", "Kevin Porter", "Kenyon Martin", "Jaren Jackson",
    "Kira Lewis", "Wendell Carter", "Derrick Jones", "Gary Trent",
)] + _contain([
    ("Gary Payton", "Gary Payton II"), ("Xavier Tillman", "Xavier Tillman Sr."), ("Louzada", "Didi Louzada"),
    ("Bamba", "Mo Bamba"), ("Bagley", "Marvin Bagley III"), ("Glenn Robinson", "Glenn Robinson III"),
    ("Iwundu", "Wesley Iwundu"), ("Clax", "Nicolas Claxton"), ("James Ennis III", "James Ennis"),
    ("Charlie Brown Jr.", "Charlie Brown"), ("Otto Porter Jr.", "Otto Porter"), ("Freedom", "Enes Kanter"),
    ("Danuel House", "Danuel House"), ("Woodard", "Robert Woodard"), ("Walker IV", "Lonnie Walker"),
    ("Mykhailiuk", "Sviatoslav Mykhailiuk"), ("Juancho Hernangómez", "Juan Hernangómez"),
])
# Roster names and the names of the statistics tables.
ROSTER_RULES = _contain([
    ("Walker IV", "Lonnie Walker"), ("Otto", "Otto Porter"), ("Sviato", "Svi Mykhailiuk"), ("Clax", "Nic Claxton"),
])


def join_by_rules(left: DataFrame, right: DataFrame, key: str, rules, how: str = "left") -> DataFrame:
    """Join on a name column after the rules have been applied to the left one."""
    fixed = apply_rules(left, key, rules)
    other = right.withColumnRenamed(key, "_rule_right")
    same = reduce(lambda a, b: a & b, [fixed[key] == other["_rule_right"]])
    return fixed.join(other, same, how).drop("_rule_right")
