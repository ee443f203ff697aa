"""URL filters: a sort-merge range join of pages with nested rules.

Hosts are written backwards, so a rule (host, path) becomes a key whose prefix relation
is an interval of the sorted keys: ``gro.elpmaxe//es/`` opens at itself and holds every
key that begins with it. A page has one key for its host and one for each parent domain,
as many labels long as rules have at most. Keys of rules and pages are sorted together;
sweeping them in order, the rules that hold the current key are a stack: a rule is pushed
where it opens, and rules that do not hold the next key are popped. Each rule carries the
stack that its opening leaves, so the sweep is a running ``last`` over sorted rows, in
ranges of the order, with the last rule before a range handed on to it.

Only DataFrame functions are used. Equal pages are one row with a count until the end, and
ties of a key are cut by the rest of the row, so a host, a parent domain or a url that many
pages share spreads over many ranges.

* A null url, or one without ``://``, has an empty host and an empty path; a null identifier is kept.
* Pages no rule fits get ``default``; so do all pages where the rules are empty.
* The longest rule wins, host and path counted together; of equally long ones that with the
  longer host. Of equal rules with different verdicts the largest counts (``block``).
* Rules with a null host, path or verdict, and hosts that no url can have, fit nothing.
* Repeated pages are all returned. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loomframe.llm.common import LOWER, UPPER
from loomframe.session import materialize

#: (host, path, verdict): a rule fits its host and all subdomains where the path begins with its own.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
DEFAULT = "allow"


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """The given rules as rows."""
    row = lambda rule: F.struct(*[F.lit(v).cast("string").alias(c) for v, c in zip(rule, ("host", "path", "verdict"))])
    return spark.range(1).select(F.inline(F.array(*map(row, rules))))


def split_url(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path of a url; both empty where it has no ``://``."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _key(host: Column, path: Column) -> Column:
    """No host of a url holds a slash, so the first one ends the host."""
    return F.concat(F.reverse(host), F.lit("/"), path)


def _nested(rules: DataFrame) -> DataFrame:
    """Each rule with the stack that is active once it has opened, outermost first.

    The rules that hold a rule are those among the prefixes of its key that keep its host.
    """
    begin = F.length("host") + 1
    inner = rules.select("host", "key", F.explode(F.sequence(begin, F.length("key"))).alias("n")).select("key", F.substring("key", 1, F.col("n")).alias("outer"))
    held = rules.select(F.col("key").alias("outer"), F.struct(F.length("key").alias("length"), "key", "host", "path", "verdict").alias("rule"))
    return inner.join(held, "outer").groupBy("key").agg(F.array_sort(F.collect_list("rule")).alias("stack"))


def filter_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT
) -> DataFrame:
    """Rows (id, host, path, rule, verdict), one for each page; ``rule`` is host and path, or null."""
    spark = pages.sparkSession
    usable = ~F.col("host").rlike("[/?#]") & F.col("path").isNotNull() & F.col("verdict").isNotNull()
    host, path = F.translate(F.col("host").cast("string"), UPPER, LOWER), F.col("path").cast("string")
    known = rules.select(host.alias("host"), path.alias("path"), F.col("verdict").cast("string").alias("verdict")).filter(usable)
    known = known.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("key", _key(F.col("host"), F.col("path")))
    known = materialize(_nested(known), "url-rules")
    depth = known.agg(F.max(_labels(F.substring_index("key", "/", 1)))).first()[0] or 1

    host, path = split_url(F.col(url_col).cast("string"))
    page = pages.select(F.col(id_col).cast("long").alias("id"), host.alias("host"), path.alias("path"))
    page = page.groupBy("id", "host", "path").agg(F.count(F.lit(1)).alias("copies"))
    levels = F.sequence(F.lit(1), F.least(_labels(F.col("host")), F.lit(depth)))
    probes = page.select("*", F.explode(levels).alias("level"))
    probes = probes.withColumn("key", _key(F.expr("substring_index(host, '.', -level)"), F.col("path")))

    # the sweep: rules open before the pages of their own key, ties of a key are cut by the row
    opens = known.select("key", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("tie"), "stack", *[F.lit(None).cast(t).alias(c) for c, t in page.dtypes])
    marks = probes.select("key", F.lit(1).alias("kind"), F.xxhash64("id", "host").alias("tie"), F.lit(None).cast(known.schema["stack"].dataType).alias("stack"), *page.columns)
    order = ["key", "kind", "tie"]
    events = opens.unionByName(marks).repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    events = materialize(events, "url-events")
    # one row for each range: the stack of the last rule that opened in it, handed on to the next ranges
    ends = events.groupBy("range").agg(F.max_by("stack", F.when(F.col("kind") == 0, F.col("key"))).alias("left"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("range", F.last("left", True).over(before).alias("carried"))
    so_far = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.withColumn("open", F.last("stack", True).over(so_far)).filter("kind = 1")
    swept = swept.join(F.broadcast(carried), "range")  # a row for each range
    stack = F.coalesce("open", "carried")
    # popping: of the stack that was left, the innermost rule that holds the key
    top = F.try_element_at(F.filter(stack, lambda r: F.startswith(F.col("key"), r["key"])), F.lit(-1))
    length = F.length(top["host"]) + F.length(top["path"])
    found = F.when(top.isNotNull(), F.struct(length.alias("length"), F.length(top["host"]).alias("hosts"), top["host"].alias("host"), top["path"].alias("path"), top["verdict"].alias("verdict")))
    best = swept.groupBy(*page.columns).agg(F.max(found).alias("best"))
    rows = best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select("id", "host", "path", F.concat("best.host", "best.path").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
