"""URL filtering by nested host and path rules, as a sort-merge range join.

A rule on a host and a path prefix covers an interval of reversed-host keys: ``example.com`` with
``/en/`` covers every key that starts with ``com.example//en/``. Intervals of prefixes are nested or
disjoint, so a sweep over the sorted keys needs only a stack of the rules that are open. The stack
travels with each rule: at a key, the rule that started last brings its stack, and the innermost
entry that still covers the key wins.

Everything here is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import ascii_lower, require, sorted_slices


def url_host(url: Column) -> Column:
    """Text between the first ``://`` and the next ``/``, ``?``, ``#`` or end; A-Z lower-cased."""
    return ascii_lower(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    """Text from the end of the host up to ``?``, ``#`` or end."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, "[.]", -1))


def _key(labels: Column, path: Column) -> Column:
    # A host holds no slash, so the slash ends it.
    return F.concat(F.array_join(labels, "."), F.lit("/"), path)


def _rule_stacks(rules: DataFrame) -> DataFrame:
    """Each rule's key with the stack of rules that cover it, itself included, outermost first.

    A prefix of a rule can only be a rule if its length is the length of some rule, so each rule
    looks its prefixes up by length. Rules with equal keys collapse: block wins over allow.
    """
    host, path = ascii_lower(F.col("host")), F.coalesce(F.col("path"), F.lit(""))
    keyed = (
        rules.filter(F.coalesce(F.length("host"), F.lit(0)) > 0)
        .select(
            _key(_labels(host), path).alias("key"),
            F.size(_labels(host)).alias("depth"),
            F.concat(host, path).alias("rule"),
            "verdict",
        )
        .groupBy("key", "depth", "rule")
        .agg(F.max("verdict").alias("verdict"))
    )
    lengths = keyed.agg(F.collect_set(F.length("key")).alias("lengths"))  # one row
    prefixes = keyed.select("key", "depth").join(F.broadcast(lengths)).select(
        F.col("key").alias("inner"),
        F.col("depth").alias("inner_depth"),
        F.explode(F.filter("lengths", lambda n: n <= F.length("key"))).alias("n"),
    )
    outer = keyed.select("key", "rule", "verdict")
    covering = prefixes.join(outer, F.expr("substring(inner, 1, n)") == F.col("key"))
    entry = F.struct(F.length("key").alias("n"), "key", "rule", "verdict")
    return covering.groupBy("inner", "inner_depth").agg(
        F.array_sort(F.collect_list(entry)).alias("stack")
    )


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``pages``.

    ``rules`` has ``host``, ``path`` and ``verdict``. A rule fits a URL if the URL's host is the rule's
    host or ends with a dot and it, and the URL's path starts with the rule's path. The longest rule
    (host and path together) wins, a tie goes to the longer host. ``rule`` is its text, or null where
    none fits; then the verdict is ``default``.

    Null URLs and URLs without ``://`` have an empty host and path and fit no rule. Rules with a null
    or empty host are ignored. Repeated rows are judged alike and all kept; other columns pass through,
    except that columns named like the four new ones are replaced.

    Equal URLs are judged once, so a URL that fills a third of the table costs one key.
    """
    require(pages, [url])
    named = pages.withColumn("_u", F.col(url)).drop("host", "path", "rule", "verdict")
    split = named.withColumns({"host": url_host(F.col("_u")), "path": url_path(F.col("_u"))}).drop("_u")
    stacks = _rule_stacks(rules)
    deepest = stacks.agg(F.coalesce(F.max("inner_depth"), F.lit(0)).alias("deepest"))  # one row
    distinct = split.select("host", "path").filter(F.length("host") > 0).distinct()
    # A host has a key for each of its parent domains, down to the longest host that a rule names.
    levels = (
        distinct.join(F.broadcast(deepest))
        .withColumn("_labels", _labels(F.col("host")))
        .withColumn("n", F.least(F.size("_labels"), F.col("deepest")))
        .filter(F.col("n") > 0)
        .select("host", "path", "_labels", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("level"))
        .select("host", "path", _key(F.slice("_labels", F.lit(1), F.col("level")), F.col("path")).alias("key"))
    )
    nothing = F.lit(None).cast(stacks.schema["stack"].dataType)
    events = levels.select("key", F.lit(1).alias("kind"), "host", "path", nothing.alias("stack")).unionByName(
        stacks.select(
            F.col("inner").alias("key"),
            F.lit(0).alias("kind"),
            F.lit(None).cast("string").alias("host"),
            F.lit(None).cast("string").alias("path"),
            "stack",
        )
    )
    swept = _sweep(sorted_slices(events, "key", "kind", "host", "path"))
    open_rules = F.filter("stack", lambda x: F.startswith(F.col("key"), x["key"]))
    found = (
        swept.filter("kind = 1")
        .withColumn("fit", F.try_element_at(open_rules, F.lit(-1)))
        .filter("fit is not null")
        .groupBy(F.col("host").alias("_host"), F.col("path").alias("_path"))
        .agg(F.max(F.struct(F.length("fit.rule").alias("n"), F.length("key").alias("m"), "fit.rule", "fit.verdict")).alias("fit"))
    )
    judged = split.join(found, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left")
    return judged.withColumns(
        {"rule": F.col("fit.rule"), "verdict": F.coalesce(F.col("fit.verdict"), F.lit(default))}
    ).drop("_host", "_path", "fit")


def _sweep(events: DataFrame) -> DataFrame:
    """Give every key the stack of the rule that started last before it.

    Within a slice that is a running last value; the stack open at a slice's start is the last one of
    the slices before it, which is looked up among one row per slice.
    """
    last = events.groupBy("_slice").agg(F.max_by("stack", F.when(F.col("stack").isNotNull(), F.col("_pos"))).alias("closing"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    opening = last.select("_slice", F.last("closing", ignorenulls=True).over(before).alias("opening"))
    within = Window.partitionBy("_slice").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    return (
        events.withColumn("stack", F.last("stack", ignorenulls=True).over(within))
        .join(opening, "_slice")
        .withColumn("stack", F.coalesce("stack", "opening"))
    )
