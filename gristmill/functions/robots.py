"""robots.txt as expressions: rules for a crawler's name, and what they say of a path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RULE = "struct<allow:boolean,pattern:string>"


def rules(text: Column, token: str) -> Column:
    """``array<struct<allow, pattern>>`` of the groups that name the token, else of those for ``*``.

    A group is a run of user-agent lines and the rules under it; groups of the
    same name add up. One fold over the lines in the JVM.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")))
    start = F.expr(f"named_struct('mine', false, 'star', false, 'agents', false, 'seen', false, 'own', cast(array() as array<{_RULE}>), 'any', cast(array() as array<{_RULE}>))")

    def step(s: Column, line: Column) -> Column:
        field = F.lower(F.trim(F.substring_index(line, ":", 1)))
        value = F.trim(F.regexp_replace(line, "^[^:]*:?", ""))
        agent = field == "user-agent"
        first = agent & ~s["agents"]
        is_mine, is_star = agent & (F.lower(value) == token.lower()), agent & (value == "*")
        mine = F.when(first, is_mine).otherwise(s["mine"] | is_mine)
        star = F.when(first, is_star).otherwise(s["star"] | is_star)
        rule = field.isin("allow", "disallow") & (value != "")
        one = F.array(F.struct((field == "allow").alias("allow"), value.alias("pattern")))
        return F.struct(
            mine.alias("mine"), star.alias("star"), F.when(field == "", s["agents"]).otherwise(agent).alias("agents"), (s["seen"] | is_mine).alias("seen"),
            F.when(rule & s["mine"], F.concat(s["own"], one)).otherwise(s["own"]).alias("own"),
            F.when(rule & s["star"], F.concat(s["any"], one)).otherwise(s["any"]).alias("any"),
        )

    return F.aggregate(lines, start, step, lambda s: F.when(s["seen"], s["own"]).otherwise(s["any"]))


def pattern_regex(pattern: Column) -> Column:
    """A rule's pattern as an anchored regular expression: ``*`` is any run, a final ``$`` the end."""
    quoted = F.regexp_replace(F.regexp_replace(pattern, r"\$$", ""), r"([\\.\[\]{}()+?^$|])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(quoted, r"\*+", ".*"), F.when(pattern.endswith("$"), "$").otherwise(""))


def allows(rules_: Column, path: Column) -> Column:
    """The longest matching pattern decides, allow where two are as long; no match allows."""
    hits = F.filter(rules_, lambda r: F.rlike(path, pattern_regex(r["pattern"])))
    best = F.array_max(F.transform(hits, lambda r: F.struct(F.char_length(r["pattern"]), r["allow"].alias("allow"))))
    return F.coalesce(best["allow"], F.lit(True))


def policy(status: Column) -> Column:
    """What a robots.txt answer means: ``parse``, ``disallow`` (429, 5xx, anything odd) or ``allow`` (other 4xx)."""
    return F.when(status.between(200, 299), "parse").when((status == 429) | status.between(500, 599), "disallow").when(status.between(400, 499), "allow").otherwise("disallow")


def crawl_delay_ms(text: Column) -> Column:
    """The first crawl-delay in milliseconds, from 0.1 to 300 seconds; null without one."""
    seconds = F.regexp_extract(text, r"(?im)^\s*crawl-delay\s*:\s*([0-9.]+)", 1).try_cast("double")
    return F.when(seconds.isNotNull(), F.least(F.greatest(F.round(seconds * 1000), F.lit(100.0)), F.lit(300_000.0)).cast("long"))


def sitemaps(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?im)^\s*sitemap\s*:\s*(\S+)"), F.lit(1))


def usage(value: Column) -> Column:
    """``struct(train_ai, search, unreadable)`` of a usage preference line: ``y``, ``n`` or null, of several the stricter; of items that say neither the first eight stay, as written."""
    items = F.filter(F.transform(F.split(value, ","), lambda x: F.btrim(x)), lambda x: x != "")
    name = lambda x: F.lower(F.btrim(F.substring_index(x, "=", 1)))
    says = lambda x: F.when(F.contains(x, F.lit("=")), F.lower(F.btrim(F.regexp_replace(x, "^[^=]*=", "")))).otherwise("")

    def of(category: str) -> Column:
        has = lambda answer: F.exists(items, lambda x: (name(x) == category) & (says(x) == answer))
        return F.when(has("n"), "n").when(has("y"), "y")

    unread = F.filter(items, lambda x: ~(name(x).isin("train-ai", "search") & says(x).isin("y", "n")))
    return F.struct(of("train-ai").alias("train_ai"), of("search").alias("search"), F.slice(F.array_distinct(unread), 1, 8).alias("unreadable"))
