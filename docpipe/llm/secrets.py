"""Secret scans over an incremental blob ledger, in DataFrame functions alone.

Every text is addressed by the SHA-256 of its content. The ledger, a table, says which blobs have been scanned by which
rule versions and what was found where. A scan reads only blobs with unseen rule versions, each once however many paths
hold it, and appends; findings are joined back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docpipe.functions.binding import let
from docpipe.llm.common import materialize, shared_dir, text_or_empty


@dataclass(frozen=True)
class Rule:
    """A pattern; a match counts if its group has at least `least` characters. Matches are leftmost and don't overlap."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The base rules, then the ones that this operator adds.
BASE_RULES = (
    Rule("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # runs are matched whole, so shorter ones can be left out of the pattern
)
ADDED_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE_RULES + ADDED_RULES
NO_ID = 2**63 - 1
#: Matches that are folded into one array.
BLOCK = 256
FINDING = "struct<kind:string,version:int,start:int,stop:int>"


def spans(rule: Rule, text: str, matches: str) -> Column:
    """Findings of one rule: offsets are summed up from the pieces between the matches and the matches themselves.

    The fold goes over blocks of BLOCK matches, as an array is copied for each element that is appended to it.
    """
    none = F.expr(f"cast(array() as array<{FINDING}>)")
    pieces = F.split(F.col(text), rule.pattern, -1)
    both = F.zip_with(pieces, F.col(matches), lambda piece, match: F.struct(F.length(F.coalesce(piece, F.lit(""))).alias("gap"), match.alias("match")))

    def add(held: Column, x: Column) -> Column:
        start = held["at"] + x["gap"]
        stop = start + F.length(F.coalesce(x["match"], F.lit("")))
        long_enough = F.length(F.regexp_extract(x["match"], rule.pattern, rule.group)) >= rule.least
        finding = F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), start.alias("start"), stop.alias("stop"))
        return F.struct(stop.alias("at"), F.when(x["match"].isNotNull() & long_enough, F.array_append(held["out"], finding)).otherwise(held["out"]).alias("out"))

    def add_block(held: Column, block: Column) -> Column:
        done = F.aggregate(block, F.struct(held["at"].alias("at"), none.alias("out")), add)
        return F.struct(done["at"].alias("at"), F.array_append(held["out"], done["out"]).alias("out"))

    def fold(pairs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(pairs) / BLOCK).cast("int")), lambda b: F.slice(pairs, b * BLOCK + 1, BLOCK))
        start = F.struct((F.size(matches) * 0).alias("at"), F.expr(f"cast(array() as array<array<{FINDING}>>)").alias("out"))
        return F.flatten(F.aggregate(blocks, start, add_block, lambda held: held["out"]))

    return F.when(F.size(matches) > 0, let(both, fold)).otherwise(none)


class BlobLedger:
    """The table blob, scanned (rule versions), findings at a path; made by the first scan."""

    SCHEMA = f"blob string, scanned array<string>, findings array<{FINDING}>"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or shared_dir(spark, "ledger")

    def exists(self) -> bool:
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(self.path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def rows(self) -> DataFrame:
        if not self.exists():
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def unseen(self, addressed: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
        """blob, a path that holds it (first), and the rule versions it has not been scanned by."""
        wanted = F.array(*[F.lit(r.key) for r in rules])
        blobs = addressed.groupBy("blob").agg(F.min("first").alias("first"))
        if not self.exists():
            return blobs.withColumn("missing", wanted)
        seen = self.rows().select("blob", F.explode("scanned").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        left = blobs.join(seen, "blob", "left").withColumn("missing", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))))
        return left.where(F.size("missing") > 0).select("blob", "first", "missing")

    def scan(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> None:
        """Appends the scans of all unseen pairs of a blob of `docs` (doc_id, text) and a rule version.

        Null texts count as the empty blob; repeated rows and ids share their blobs, each scanned once; empty tables append
        an empty scan; other columns are not read. Where nothing is unseen no text is shuffled: the join's other side is empty.
        """
        rows = addressed(docs, keep_text=True)
        todo = materialize(self.unseen(rows.select("blob", "first"), rules), "unseen")
        texts = rows.join(todo, ["first", "blob"]).select("blob", "text", "missing")
        found = texts.withColumns({f"m_{r.kind}": F.when(F.array_contains("missing", r.key), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))).otherwise(F.array().cast("array<string>")) for r in rules})
        each = [spans(r, "text", f"m_{r.kind}") for r in rules]
        out = found.select("blob", F.col("missing").alias("scanned"), F.concat(*each).alias("findings")).dropDuplicates(["blob"])
        out.write.mode("append").parquet(self.path)

    def findings(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """doc_id, blob and findings (by start, then the rules' order) of every row of `docs`.

        Repeated rows repeat, null ids stay, null texts have the empty blob's findings (none); blobs not scanned have none.
        """
        order = F.array(*[F.lit(r.kind) for r in rules])
        current = self.rows().where(F.size("findings") > 0).select("blob", F.explode("findings").alias("f")).where(F.concat_ws("@", "f.kind", F.col("f.version").cast("string")).isin([r.key for r in rules]))
        keyed = current.select("blob", F.struct(F.col("f.start").alias("start"), F.array_position(order, F.col("f.kind")).alias("rank"), F.col("f.kind").alias("kind"), F.col("f.stop").alias("stop")).alias("f"))
        by_blob = materialize(keyed.groupBy("blob").agg(F.array_sort(F.collect_set("f")).alias("findings")), "findings")
        return addressed(docs, keep_text=False).join(by_blob, "blob", "left").select("doc_id", "blob", F.coalesce("findings", F.expr("cast(array() as array<struct<start:int,rank:bigint,kind:string,stop:int>>)")).alias("findings"))


def addressed(docs: DataFrame, keep_text: bool) -> DataFrame:
    """doc_id, first (the id, the largest for null) and blob, the text's SHA-256; null texts count as empty."""
    doc_id = docs["doc_id"].cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(NO_ID)).alias("first"), text_or_empty().alias("text"))
    rows = rows.withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))
    return rows if keep_text else rows.drop("text")


def report(docs: DataFrame, ledger: BlobLedger | None = None) -> DataFrame:
    """Scans what the ledger has not seen; doc_id, counts by base kind, base_sha256 and spans of every row of `docs`.

    Null texts count as empty and have no findings; repeated rows repeat; a blob that many rows share is scanned once. Of
    findings that start together the order is that of the rules. Empty tables give no rows; other columns are not read.
    """
    ledger = ledger or BlobLedger(docs.sparkSession)
    ledger.scan(docs)
    kinds = [r.kind for r in BASE_RULES]
    listed = lambda c: F.concat_ws(",", F.transform(c, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["stop"].cast("string"))))
    base = F.filter("findings", lambda f: f["kind"].isin(kinds))
    counts = [F.size(F.expr(f"filter(findings, f -> f.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in kinds]
    return ledger.findings(docs).select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"))
