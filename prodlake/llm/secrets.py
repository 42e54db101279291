"""Secret scans over an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its content.  The ledger, a folder of
two Parquet tables, remembers which path versions there are (``versions``: a path, a blob, and how
often one scan gave this pair) and, per scan of a blob, the rule versions it was scanned with and
what each of them found (``scans``).  A scan reads the given contents, keeps one of each blob, and
runs only the pairs of blob and rule version that the ledger lacks; findings join back to all paths
by blob.  A span names the rule version that found it, and only those of current rules count.

A rule is a Java regular expression.  Places come from the expression alone: the pieces between
the matches and the matches themselves add up to code-point offsets, so no Python is needed.
Matches of a rule are leftmost and do not overlap; one whose checked group is too short is
dropped after it has used up its text.

Defined cases: a null content is empty; blobs without findings are in the ledger all the same;
rows that one scan repeats have their findings as often, a row that a later scan repeats is the
same version; a null path has its findings like any other; empty tables add nothing; other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    group: int = 0  # the group that must be long enough
    least: int = 1  # characters
    hint: str | None = None  # a substring of every match

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# Fixed by the contract: kinds, patterns and least lengths of the first three, in this order.  As
# runs of [0-9a-f] are maximal, those of 16 or more are what {16,} finds.
BASE = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18, "AKIA"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
)
RULES = (
    *BASE,
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", hint="-----BEGIN "),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
)

COPIES = 10_000  # copies of a version that one row of the ledger counts at most

SPAN = "struct<start:bigint,end:bigint,kind:string,version:int>"


def rule_spans(text: Column, rule: Rule) -> Column:
    """The spans of a rule in a text, as an array in text order."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    checked = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    parts = F.arrays_zip(found.alias("m"), checked.alias("c"), F.split(text, rule.pattern).alias("gap"))
    start = F.aggregate(
        # the piece after the last match has no match beside it
        F.filter(parts, lambda p: p["m"].isNotNull()),
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["gap"]) + F.length(p["m"])).alias("at"),
            F.when(
                F.length(p["c"]) >= rule.least,
                F.concat(acc["spans"], F.array(F.struct(
                    (acc["at"] + F.length(p["gap"])).alias("start"), (acc["at"] + F.length(p["gap"]) + F.length(p["m"])).alias("end"),
                    F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"),
                ))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )["spans"]
    present = text.contains(rule.hint) if rule.hint else text.rlike(rule.pattern)
    return F.when(present, start).otherwise(F.array().cast(f"array<{SPAN}>"))


class Ledger:
    """Path versions and blob scans below a shared folder."""

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES) -> None:
        self._spark, self._path, self._rules = spark, path, rules

    def _read(self, name: str, schema: str) -> DataFrame:
        fs_path = self._spark._jvm.org.apache.hadoop.fs.Path(f"{self._path}/{name}")
        if not fs_path.getFileSystem(self._spark._jsparkSession.sessionState().newHadoopConf()).exists(fs_path):
            return self._spark.createDataFrame([], schema)
        return self._spark.read.schema(schema).parquet(f"{self._path}/{name}")

    def versions(self) -> DataFrame:
        """``path, blob, copies``; a scan adds the copies of a version that the ledger did not know yet."""
        return self._read("versions", "path bigint, blob string, copies bigint")

    def scans(self) -> DataFrame:
        return self._read("scans", f"blob string, rules array<string>, spans array<{SPAN}>")

    def scan(self, contents: DataFrame) -> None:
        """Record the versions ``path, content`` and scan what is unseen of them.

        Copies of a blob are combined before the shuffle, so a blob that a third of all paths
        hold costs one row per task.  A scan that is repeated, after a failure or for no reason, adds
        nothing: pairs of blob and rule version and versions that the ledger holds are left out.
        """
        text = F.coalesce("content", F.lit(""))
        named = contents.select(F.col("path").cast("bigint"), text.alias("content")).withColumn("blob", F.sha2(F.encode("content", "UTF-8"), 256))
        seen = self.scans().select(F.col("blob").alias("seen"), F.explode("rules").alias("rule"))
        seen = seen.groupBy("seen").agg(F.collect_set("rule").alias("done"))
        every = F.array(*[F.lit(r.key) for r in self._rules])
        blobs = named.groupBy("blob").agg(F.any_value("content").alias("content"))
        open_ = blobs.join(seen, F.col("blob") == F.col("seen"), "left").withColumn(
            "rules", F.array_except(every, F.coalesce("done", F.array().cast("array<string>")))
        ).filter(F.size("rules") > 0)
        nothing = F.array().cast(f"array<{SPAN}>")
        spans = [F.when(F.array_contains("rules", r.key), rule_spans(F.col("content"), r)).otherwise(nothing) for r in self._rules]
        scanned = open_.select("blob", "rules", F.concat(*spans).alias("spans"))
        scanned.write.mode("append").parquet(f"{self._path}/scans")
        given = named.groupBy("path", "blob").agg(F.count("*").alias("given"))
        known = self.versions().groupBy(F.col("path").alias("_path"), F.col("blob").alias("_blob")).agg(F.sum("copies").alias("known"))
        same = F.col("path").eqNullSafe(F.col("_path")) & (F.col("blob") == F.col("_blob"))
        more = (F.col("given") - F.coalesce("known", F.lit(0))).alias("copies")
        added = given.join(known, same, "left").select("path", "blob", more).filter("copies > 0")
        parts = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1, F.lit(COPIES).cast("bigint")), lambda at: F.least(F.lit(COPIES).cast("bigint"), F.col("copies") - at))
        added = added.select("path", "blob", F.explode(parts).alias("copies"))
        added.write.mode("append").parquet(f"{self._path}/versions")

    def findings(self) -> DataFrame:
        """``path, blob, spans`` of every version, the spans of the current rules in text order, then
        in that of the rules."""
        keys = F.array(*[F.lit(r.key) for r in self._rules])
        kinds = F.array(*[F.lit(r.kind) for r in self._rules])
        current = F.arrays_overlap("rules", keys)
        per_blob = self.scans().filter(current).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        own = F.filter("spans", lambda s: F.array_contains(keys, F.concat_ws("@", s["kind"], s["version"].cast("string"))))
        ranked = F.transform(own, lambda s: F.struct(s["start"], (F.array_position(kinds, s["kind"]) - 1).alias("rank"), s["end"], s["kind"]))
        found = per_blob.select(F.col("blob").alias("of"), F.array_sort(F.array_distinct(ranked)).alias("spans"))
        joined = self.versions().join(found, F.col("blob") == F.col("of"))
        return joined.select("path", "blob", "spans", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy")).drop("copy")


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """``doc_id``, counts and spans of every row of ``docs`` (doc_id, text), through a ledger;
    by default a fresh one in the shared folder."""
    spark = docs.sparkSession
    ledger = ledger or Ledger(spark, scratch_path(spark, "ledger"))
    ledger.scan(docs.select(F.col("doc_id").alias("path"), F.col("text").alias("content")))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, r.kind)) for r in BASE]
    counts = [(F.size("spans") - other).cast("long").alias(f"n_{r.kind}") for other, r in zip(counts, BASE, strict=True)]
    return ledger.findings().select(
        F.col("path").alias("doc_id"), *counts, F.sha2(F.encode(spelled(base), "UTF-8"), 256).alias("base_sha256"),
        spelled(F.col("spans")).alias("spans"),
    )


def duckdb_spans() -> str:
    """The spans of all rules as a DuckDB list expression over a column ``t``; for tests."""
    lists = []
    for rank, rule in enumerate(RULES):
        p = rule.pattern.replace("'", "''")
        m, g = f"regexp_extract_all(t, '{p}')", f"string_split_regex(t, '{p}')"
        c = f"regexp_extract_all(t, '{p}', {rule.group})" if rule.group else m
        at = f"CAST(list_sum(list_transform({g}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform({m}[1:i - 1], lambda x: length(x))), 0) AS BIGINT)"
        lists.append(
            f"list_transform(list_filter(generate_series(1, len({m})), lambda i: length({c}[i]) >= {rule.least}), "
            f"lambda i: {{'s': {at}, 'r': {rank}, 'e': {at} + length({m}[i]), 'k': '{rule.kind}'}})"
        )
    return f"list_sort(list_concat(list_concat(list_concat(list_concat({lists[0]}, {lists[1]}), {lists[2]}), {lists[3]}), {lists[4]}))"
