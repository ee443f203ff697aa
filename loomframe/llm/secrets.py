"""Secret scans over a ledger of content-addressed blobs.

Every version of every text has an address, the SHA-256 of its content. The
ledger keeps which rule versions have seen which address and what they found.
A run scans only the missing (address, rule version) pairs, each content once,
and joins the findings back to all rows that hold it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomframe.llm.bytewords import release
from loomframe.llm.common import id_and_text
from loomframe.llm.membership import build, perhaps
from loomframe.llm.rows import free_names
from loomframe.session import materialize, scratch_path

FOUND = "array<struct<kind:string,first:int,last:int>>"
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds; a match counts when ``group`` has ``least`` characters; ``hint`` (RE2) is true wherever it could."""

    kind: str
    version: int
    pattern: str
    hint: str
    group: int = 0
    least: int = 1

    @property
    def tag(self) -> str:
        return f"{self.kind}@{self.version}"


# A private key reaches from its first to its last line; where no last line comes before the next
# block, to the end of the base64 run: header lines, runs of 16 characters or more, and a shorter one after
# them. Line breaks may be any white space or stand escaped.
_BEGIN = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"
_GAP = r"(?:\s|\\[nrt])+"
_REST = rf"(?:{_GAP}(?:Proc-Type|DEK-Info):\x20*[A-Za-z0-9,-]+)*(?:(?:{_GAP})?[A-Za-z0-9+/]{{16,}}={{0,2}})*(?:(?<=[A-Za-z0-9+/=]){_GAP}[A-Za-z0-9+/]{{1,15}}={{0,2}}(?![A-Za-z0-9+/=]))?"

#: In the order in which spans that start together are listed.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", 2, 8),
    # Runs are maximal, so the least length may stand in the pattern.
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", r"AKIA[A-Z0-9]{12}"),
    Rule("hex", 1, r"[0-9a-f]{32,}", r"[0-9a-f]{32}"),
    Rule("pem", 2, _BEGIN + rf"(?:(?:[^-]+|-(?!----(?:BEGIN|END)\x20))*+-----END [A-Z0-9 ]*PRIVATE KEY-----|{_REST})", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"),
)


def find(text: str, rules: tuple[Rule, ...]) -> list[dict]:
    """Leftmost non-overlapping matches of each rule, by start and then rule; code points."""
    found = []
    for order, rule in enumerate(rules):
        for m in re.compile(rule.pattern, re.ASCII).finditer(text):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), order, {"kind": rule.kind, "first": m.start(), "last": m.end()}))
    return [x[2] for x in sorted(found, key=lambda x: x[:2])]


def addressed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, address and text of each row; null text is empty."""
    base = id_and_text(docs, id_col, text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))
    return base.select("id", F.unhex(F.sha2("text", 256)).alias("address"), "text")


def search(texts: pa.Array, todo: list[list[str]], rules: tuple[Rule, ...]) -> list[list[dict]]:
    """What ``find`` gives for each text and its own rules."""
    text = texts.cast(pa.large_string())
    hints = [pc.match_substring_regex(text, r.hint).to_numpy(zero_copy_only=False) for r in rules]
    found: list[list[dict]] = [[] for _ in range(len(text))]
    for k in sorted({int(k) for hint in hints for k in hint.nonzero()[0]}):
        found[k] = find(text[k].as_py(), tuple(r for r, hint in zip(rules, hints) if hint[k] and r.tag in todo[k]))
    return found


def scan_blobs(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(address, todo, text) to (address, todo, found); todo lists the tags to run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = search(batch.column("text"), batch.column("todo").to_pylist(), rules)
            yield pa.record_batch([batch.column("address"), batch.column("todo"), pa.array(found, _TYPE)], names=["address", "todo", "found"])
        release()

    return texts.mapInArrow(run, f"address binary, todo array<string>, found {FOUND}")


def scan_unless(texts: DataFrame, bits: np.ndarray, todo: list[str], rules: tuple[Rule, ...]) -> DataFrame:
    """Scan the rows whose key is surely not in the filter; pass the others on with their text."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            later = perhaps(shared.value, batch.column("key").to_numpy(zero_copy_only=False))
            now = pa.array(~later)
            text = batch.column("text")
            found = iter(search(text.filter(now), [todo] * int((~later).sum()), rules))
            out = [None if wait else next(found) for wait in later]
            kept = pc.if_else(now, pa.scalar(None, text.type), text)
            yield pa.record_batch([batch.column("id"), batch.column("address"), kept, pa.array([todo] * len(text), pa.list_(pa.string())), pa.array(out, _TYPE)], names=["id", "address", "text", "todo", "found"])
        release()

    return texts.mapInArrow(run, f"id long, address binary, text string, todo array<string>, found {FOUND}")


def only_perhaps(texts: DataFrame, bits: np.ndarray) -> DataFrame:
    """The rows whose key may be in the filter."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(perhaps(shared.value, batch.column("key").to_numpy(zero_copy_only=False))))

    return texts.mapInArrow(run, texts.schema)


def ledger_rows(spark: SparkSession, ledger: str) -> DataFrame | None:
    """What earlier runs have written to the ledger, or None before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(ledger)


def findings(docs: DataFrame, ledger: str | None, rules: tuple[Rule, ...], id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Bring the ledger up to date; return (id, address) of all rows and (address, found) of the contents with findings."""
    spark = docs.sparkSession
    ledger = ledger or scratch_path(spark, "blob-ledger")
    texts = addressed(docs, id_col, text_col)
    rows = materialize(texts.select("id", "address"), "blob-addresses")
    want = F.array(*(F.lit(r.tag) for r in rules))

    # The row with the smallest identifier stands for its content.
    blobs = rows.groupBy("address").agg(F.min("id").alias("reader"))
    past = ledger_rows(spark, ledger)
    if past is None:
        due = blobs.withColumn("todo", want)
    else:
        seen = past.select("address", F.explode("todo").alias("tag")).distinct().groupBy("address").agg(F.collect_set("tag").alias("seen"))
        due = blobs.join(seen, "address", "left").withColumn("todo", F.array_except(want, F.coalesce("seen", F.array().cast("array<string>")))).filter(F.size("todo") > 0)
    due = materialize(due, "blobs-due")
    key = lambda of: F.xxhash64("address", of)
    texts = texts.withColumn("key", key("id"))
    n_due, kinds_due = due.agg(F.count("*"), F.count_distinct("todo")).first()
    if kinds_due <= 1 and 2 * n_due > rows.count():
        # Most rows are read: those that surely are no copies at once, the rest after an exact look at who reads them.
        todo = due.select("todo").first()["todo"]
        reader = F.col("id").eqNullSafe(F.col("reader"))
        held = rows.join(due.select("address", "reader"), "address", "left").filter(~reader | F.col("reader").isNull() & F.col("id").isNotNull())
        skip = materialize(held.select("id", "address").distinct(), "rows-to-skip")
        first = materialize(scan_unless(texts, build(skip.select(key("id")), skip.count()), todo, rules), "first-scan")
        open_ = first.filter("text is not null")
        unseen = open_.join(skip, (open_["address"] == skip["address"]) & open_["id"].eqNullSafe(skip["id"]), "left_anti")
        done = first.filter("text is null").select("address", "todo", "found").unionByName(scan_blobs(unseen.select("address", "todo", "text"), rules))
    else:
        maybe = only_perhaps(texts, build(due.select(key("reader")), n_due))
        unseen = maybe.join(due, (maybe["address"] == due["address"]) & maybe["id"].eqNullSafe(due["reader"])).drop(due["address"])
        done = scan_blobs(unseen.select("address", "todo", "text"), rules)
    done.write.mode("append").parquet(ledger)

    place = {r.kind: (k, r.tag) for k, r in enumerate(rules)}
    of_kind = lambda n: F.create_map(*(F.lit(x) for kind, v in place.items() for x in (kind, v[n])))[F.col("f.kind")]
    spans = spark.read.parquet(ledger).filter(F.size("found") > 0).select("address", "todo", F.explode("found").alias("f"))
    current = spans.filter(F.array_contains("todo", of_kind(1))).select("address", F.struct("f.first", of_kind(0).alias("at"), "f.kind", "f.last").alias("f"))
    by_blob = current.distinct().groupBy("address").agg(F.array_sort(F.collect_list("f")).alias("found"))
    return rows, by_blob.withColumn("found", F.transform("found", lambda f: F.struct(f["kind"].alias("kind"), f["first"].alias("first"), f["last"].alias("last"))))


def scan_secrets(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings of every row: id, found (array of kind, first, last; code points, end exclusive).

    ``ledger`` is a folder on shared storage that later runs give again; without it
    the run starts from an empty one. Null text is empty and has no findings; null
    identifiers and repeated rows are rows like any other; an empty table gives an
    empty result; other columns are not read.
    """
    rows, by_blob = findings(docs, ledger, rules, id_col, text_col)
    return rows.join(by_blob, "address", "left").select("id", F.coalesce("found", F.array().cast(FOUND)).alias("found"))


def mask_spans(text: str | None, found: list | None, mask: str) -> str | None:
    """``text`` with each found span, or run of overlapping spans, replaced by ``mask``; as it is where none was found."""
    if text is None or not found:
        return text
    out, at = [], 0
    for f in found:
        if f["first"] >= at:
            out += [text[at : f["first"]], mask]
        at = max(at, f["last"])
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mask: str = "[SECRET]", ledger: str | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all columns, its secrets masked; rows without findings stay as they are, null texts too.

    Repeated rows and null identifiers are rows like any other; an empty table gives an
    empty result; other columns pass through, whatever their names.
    """
    own, maybe, found = free_names(docs, "_address", "_maybe", "_found")
    _, by_blob = findings(docs, ledger, rules, id_col, text_col)
    secret = materialize(by_blob, "secret-blobs")
    address = F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))
    masked = F.udf(lambda text, found: mask_spans(text, found, mask), "string")
    bits = build(secret.select(F.xxhash64("address")), secret.count())
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def may_hold(key: pd.Series) -> pd.Series:
        return pd.Series(perhaps(shared.value, key.to_numpy()))

    marked = docs.withColumn(own, address).withColumn(maybe, may_hold(F.xxhash64(own)))
    held = marked.filter(F.col(maybe)).join(secret.select(F.col("address").alias(own), F.col("found").alias(found)), own, "left")
    clean = held.withColumn(text_col, masked(F.col(text_col).cast("string"), F.col(found)))
    return marked.filter(~F.col(maybe)).select(*docs.columns).unionByName(clean.select(*docs.columns))
