"""Secret scans over an incremental ledger of blobs, by built-in functions only.

Every version of a text is a blob under its SHA-256. The ledger has, for each blob, the rule
versions that scanned it and what they found; a run scans only blobs and rule versions that
the ledger lacks, and joins what is known of a blob back to every path that holds it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, offered, table, written
from .spans import joined, with_matches

#: The session's setting that names the folder of a ledger which the query reads and extends.
LEDGER_PATH = "spark.factlake.secrets.ledger"
LEDGER = "blob string, rules array<string>, findings array<struct<rule:string,start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches are kept if the value (group 1 of `value`, else all) is long enough."""

    kind: str
    version: int
    pattern: str
    least: int = 0
    value: str | None = None
    needs: str | None = None

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"

    def keeps(self, match: Column) -> Column:
        return F.length(F.regexp_extract(match, self.value, 1) if self.value else match) >= self.least


_ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: The base rules come first, in the order in which they are listed.
BASE = (
    Rule("assign", 1, _ASSIGN, 6, _ASSIGN),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 20, needs="AKIA"),
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{24,}+", 24),
)
RULES = (
    *BASE,
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", needs="-----BEGIN "),
    Rule("jwt", 1, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{16,}+", needs="eyJ"),
)


def _unseen(source: DataFrame, ledger: DataFrame | None, names: list[str]) -> DataFrame:
    """(blob, body, seen): the text of each blob that a rule has not scanned; only texts with copies are shuffled."""
    counted = source.groupBy("blob").agg(F.count("*").alias("n"))
    none = F.array().cast("array<string>")
    if ledger is None:
        copied = offered(written(counted.where("n > 1").select("blob")), 96)
        lone = source.join(copied, "blob", "left_anti").withColumn("seen", none)
        shared = source.join(copied, "blob", "left_semi").withColumn("seen", none)
    else:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        todo = counted.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", none))
        todo = written(todo.where(F.size(F.array_except(F.array(*map(F.lit, names)), "seen")) > 0))
        held = source.join(offered(todo, 128 + 24 * F.size("seen")), "blob")
        lone, shared = held.where("n = 1"), held.where("n > 1")
    once = shared.groupBy("blob").agg(F.first("body").alias("body"), F.first("seen").alias("seen"))
    return lone.select("blob", "body", "seen").unionByName(once)


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings, news): what is known of every row, and the rows to append to the ledger.

    findings: (id, blob, spans), spans an array of (start, number, end, kind) sorted by start
    and then rule order, empty where nothing was found. Null texts count as empty. Equal texts
    are one blob, scanned once, where it lies unless it has copies, and found under every id;
    repeated and null ids keep their rows. The ledger holds a row for each run that scanned a
    blob; rules of other versions in it are passed over. Other columns are not read; empty
    tables give empty results.
    """
    names = [r.name for r in rules]
    source = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body")).withColumn("blob", F.sha2(F.col("body").cast("binary"), 256))
    blobs = _unseen(source.select("blob", "body"), ledger, names)
    for r in rules:
        unseen = ~F.array_contains("seen", r.name)
        blobs = with_matches(blobs, "body", r.pattern, r.kind, unseen & F.contains("body", F.lit(r.needs)) if r.needs else unseen)

    def findings_of(rule: Rule) -> Column:
        kept = F.filter(rule.kind, lambda s: rule.keeps(s["match"]))
        return F.transform(kept, lambda s: F.struct(F.lit(rule.name).alias("rule"), s["start"].alias("start"), s["end"].alias("end")))

    found = F.concat(*map(findings_of, rules))
    news = written(blobs.select("blob", F.array_except(F.array(*map(F.lit, names)), "seen").alias("rules"), found.alias("findings")))
    known = news.select("blob", "findings").where(F.size("findings") > 0)
    if ledger is not None:
        known = known.unionByName(ledger.select("blob", "findings").where(F.size("findings") > 0)).groupBy("blob").agg(F.flatten(F.collect_list("findings")).alias("findings"))
    numbers = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)))
    current = F.filter("findings", lambda f: f["rule"].isin(names))
    spans = F.array_sort(F.array_distinct(F.transform(current, lambda f: F.struct(f["start"].alias("start"), numbers[f["rule"]].alias("number"), f["end"].alias("end"), F.substring_index(f["rule"], "@", 1).alias("kind")))))
    known = written(known.select("blob", spans.alias("spans")))
    none = F.array().cast("array<struct<start:int,number:int,end:int,kind:string>>")
    findings = source.select(id_col, "blob").join(offered(known, 128 + 40 * F.size("spans")), "blob", "left").select(id_col, "blob", F.coalesce("spans", none).alias("spans"))
    return findings, news


def scan_with_ledger(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The findings of scan() with the ledger in a folder, to which what is scanned is appended; made if missing."""
    spark = docs.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    findings, news = scan(docs, spark.read.schema(LEDGER).parquet(path) if there else None, rules, id_col, text_col)
    news.write.mode("append").parquet(path)
    discard(news)
    return findings


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), spark.conf.get(LEDGER_PATH, None)
    findings = scan_with_ledger(docs, path) if path else scan(docs)[0]
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["number"] < len(BASE))
    return findings.select("doc_id", *(of(r.kind).alias(f"n_{r.kind}") for r in BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {"op9_secret_scan": op9_secret_scan}
SQL: dict[str, str] = {}
