"""From words on pages to grids, tables that go on over pages, and paragraphs packed into chunks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..registry import Registry
from ..sources.bridge import read
from .ingest import value_columns

registry = Registry()

#: What counts as a number: dashes, and figures with signs, brackets, separators and per cent.
NUMBER = r"^(?:[-–—]|\(?[-−]?[0-9][0-9,]*(?:\.[0-9]+)?\)?%?)$"
#: Characters of a chunk, and of its overlap with the one before.
CHUNK, OVERLAP = 2_800, 250


def word_rows(words: DataFrame, tolerance: float = 8.0) -> DataFrame:
    """(*, row): words (page, word, top, x0, *) put into rows from 0, downwards.

    Words are taken by top, then x0, then word; one within tolerance of the first word of the row
    joins it, the next begins a row. The order decides, so each page is one fold over its sorted
    words, which holds a row's first top and streams pages of any length. Words without a page or
    top are left out.
    """
    place = words.where("page IS NOT NULL AND top IS NOT NULL").repartition("page").sortWithinPartitions("page", "top", "x0", "word")

    def rows(batches):
        page, first, row = None, 0.0, -1
        for batch in batches:
            out = []
            for p, top in zip(batch.column(at_page).to_pylist(), batch.column(at_top).to_pylist(), strict=True):
                if p != page:
                    page, first, row = p, top, 0
                elif abs(top - first) > tolerance:
                    first, row = top, row + 1
                out.append(row)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=[*batch.schema.names, "row"])

    at_page, at_top = words.columns.index("page"), words.columns.index("top")
    return place.mapInArrow(rows, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema), "row int"]))


def word_grid(words: DataFrame, row_tolerance: float = 8.0, gap: float = 25.0) -> DataFrame:
    """(page, row, col, text): words (page, word, top, x0, x1, text) as cells; col 0 is the label.

    Right edges of numbers chain into value columns, which must recur in a tenth of the page's
    rows, two at least, unless none does. Words that end left of the first column's leftmost
    number less 2 are the label; each other one goes to the column whose right edge is nearest.
    A page without numbers has labels only; columns without text have no cells.
    """
    placed = word_rows(words.select("page", "word", "top", "x0", "x1", "text"), row_tolerance)
    numbers = placed.where(F.trim("text").rlike(NUMBER))
    counted = placed.groupBy("page").agg(F.countDistinct("row").alias("n_rows"))
    of_number = value_columns(numbers.select("page", "word", "top", "x1"), gap, counted)
    left = of_number.where("column = 1").join(numbers.select("page", "word", "x0", "x1"), ["page", "word"]).where(F.abs(F.col("x1") - F.col("right")) <= gap)
    edge = left.groupBy("page").agg((F.min("x0") - 2.0).alias("edge"))
    columns = of_number.select("page", "column", "right").distinct()
    values = placed.join(edge, "page").where("x1 > edge").join(columns, "page").groupBy("page", "row", "word", "x0", "text").agg(F.min(F.struct(F.abs(F.col("x1") - F.col("right")).alias("far"), "column")).alias("x"))
    labels = placed.join(edge, "page", "left").where("edge IS NULL OR x1 <= edge")
    cells = values.select("page", "row", F.col("x.column").alias("col"), "x0", "word", "text").unionByName(labels.select("page", "row", F.lit(0).alias("col"), "x0", "word", "text"))
    joined = cells.groupBy("page", "row", "col").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "word", "text"))), lambda w: w["text"]), " ").alias("text"))
    return joined.where("text <> ''")


def continued_tables(tables: DataFrame) -> DataFrame:
    """(*, table_no, start): tables (doc, first_page, last_page, place, n_cols, section, has_year_header) joined over pages.

    In the order of first_page and place, a table goes on the one before it if it begins on the very
    next page, has as many columns, the same section (both unknown is the same) and no year header.
    """
    order = W.partitionBy("doc").orderBy("first_page", "place")
    before = lambda c: F.lag(c).over(order)
    goes_on = (F.col("first_page") - before("last_page") == 1) & (F.col("n_cols") == before("n_cols")) & F.col("section").eqNullSafe(before("section")) & ~F.coalesce("has_year_header", F.lit(False)) & before("doc").isNotNull()
    marked = tables.withColumn("starts", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("table_no", F.sum("starts").over(order))
    first = F.min(F.struct("first_page", "place")).over(W.partitionBy("doc", "table_no"))
    return marked.withColumn("start", first["first_page"]).drop("starts")


@udtf(returnType="doc string, section string, chunk int, text string")
class PackParagraphs:
    """Paragraphs of one partition, in order, packed greedily; each chunk begins with the end of the one before."""

    def __init__(self):
        self.key, self.now, self.n = None, "", 0

    def eval(self, row):
        most, overlap, para = row["most"], row["overlap"], row["paragraph"]
        self.key = (row["doc"], row["section"])
        if self.now and len(self.now) + len(para) + 1 > most:
            yield self._chunk(self.now)
            tail = self.now[-overlap:] if overlap else ""
            self.now = f"{tail}\n{para}".strip()
        else:
            self.now = f"{self.now}\n{para}" if self.now else para
        while len(self.now) > most:  # one paragraph longer than a chunk
            yield self._chunk(self.now[:most].strip())
            self.now = self.now[most - overlap :].strip()

    def terminate(self):
        if self.now:
            yield self._chunk(self.now)

    def _chunk(self, text):
        self.n += 1
        return (*self.key, self.n - 1, text)


def packed_paragraphs(sections: DataFrame, most: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc, section, chunk, text) of sections (doc, section, text), strings; overlap is below most.

    Lines are paragraphs, their white space collapsed and empty ones left out. They are packed, in
    order, while they fit into `most` characters; a further chunk begins with the last `overlap`
    characters of the one before, and a longer paragraph is cut. Chunks never cross a section; a
    table function partitioned by doc and section does it, and holds one chunk. Sections without
    text have none; several rows of a section are several texts, one after the other.
    """
    if not 0 <= overlap < most:
        raise ValueError("overlap must be at least 0 and below most")
    spark = sections.sparkSession
    lines = sections.withColumn("text_key", F.xxhash64("text")).select("doc", "section", "text_key", F.posexplode(F.split("text", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")).alias("place", "line"))
    paragraphs = lines.select(F.col("doc").cast("string").alias("doc"), F.col("section").cast("string").alias("section"), "text_key", "place", F.trim(F.regexp_replace("line", r"\s+", " ")).alias("paragraph"), F.lit(most).alias("most"), F.lit(overlap).alias("overlap")).where("paragraph <> ''")
    spark.udtf.register("factlake_pack_paragraphs", PackParagraphs)
    return spark.sql("SELECT * FROM factlake_pack_paragraphs(TABLE({paragraphs}) PARTITION BY (doc, section) ORDER BY (text_key, place))", paragraphs=paragraphs)


_ROWS_SQL = "w AS (SELECT l_orderkey AS page, l_linenumber AS word, CAST(l_linenumber * 5 + CAST(floor(l_quantity) AS INT) % 7 AS DOUBLE) AS top, CAST(floor(l_discount * 100) AS DOUBLE) AS x0, l_partkey FROM lineitem)"


@registry.add(
    "word_rows",
    f"""WITH {_ROWS_SQL}, f AS (SELECT page, list(word ORDER BY top, x0, word) AS words, list_reduce(list_prepend({{'top': CAST(NULL AS DOUBLE), 'first': CAST(NULL AS DOUBLE), 'row': CAST(-1 AS INT), 'rows': CAST([] AS INT[])}}, list({{'top': top, 'first': CAST(NULL AS DOUBLE), 'row': CAST(0 AS INT), 'rows': CAST([] AS INT[])}} ORDER BY top, x0, word)),
      lambda s, x: CASE WHEN s.first IS NOT NULL AND abs(x.top - s.first) <= 8 THEN {{'top': x.top, 'first': s.first, 'row': s.row, 'rows': list_append(s.rows, s.row)}} ELSE {{'top': x.top, 'first': x.top, 'row': s.row + 1, 'rows': list_append(s.rows, s.row + 1)}} END) AS s FROM w GROUP BY page)
    SELECT page, unnest(words) AS word, unnest(s.rows) AS "row" FROM f""",
)
def word_rows_query(spark, sf_dir):
    """Lines of an order as words of a page, their height from number and quantity."""
    line = read(spark, sf_dir, "lineitem")
    words = line.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("word"), (F.col("l_linenumber") * 5 + F.floor("l_quantity").cast("int") % 7).cast("double").alias("top"), F.floor(F.col("l_discount") * 100).cast("double").alias("x0"))
    return word_rows(words).select("page", "word", "row")


_TABLES_SQL = """t AS (SELECT o_custkey AS doc, o_orderkey AS place, CAST(row_number() OVER w + count(*) FILTER (o_orderkey % 5 = 0) OVER w AS INT) AS first_page, 3 + CAST(o_orderkey % 9 = 0 AS INT) AS n_cols, CASE WHEN o_orderkey % 11 <> 0 THEN 'notes' END AS section, o_orderkey % 7 = 0 AS has_year_header
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING))"""


@registry.add(
    "continued_tables",
    f"""WITH {_TABLES_SQL}, g AS (SELECT *, CASE WHEN first_page - lag(first_page) OVER w = 1 AND n_cols = lag(n_cols) OVER w AND section IS NOT DISTINCT FROM lag(section) OVER w AND NOT has_year_header AND lag(doc) OVER w IS NOT NULL THEN 0 ELSE 1 END AS starts FROM t WINDOW w AS (PARTITION BY doc ORDER BY first_page, place)),
    n AS (SELECT *, sum(starts) OVER (PARTITION BY doc ORDER BY first_page, place) AS table_no FROM g) SELECT doc, place, first_page, CAST(table_no AS BIGINT) AS table_no, min(first_page) OVER (PARTITION BY doc, table_no) AS start FROM n""",
)
def continued_tables_query(spark, sf_dir):
    """Orders of a customer as tables of one page each, with gaps, other columns, sections and headers by their keys."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    run = W.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(W.unboundedPreceding, 0)
    page = (F.count("*").over(run) + F.count(F.when(k % 5 == 0, 1)).over(run)).cast("int")
    tables = o.select(F.col("o_custkey").alias("doc"), k.alias("place"), page.alias("first_page"), page.alias("last_page"), (F.lit(3) + (k % 9 == 0).cast("int")).alias("n_cols"), F.when(k % 11 != 0, "notes").alias("section"), (k % 7 == 0).alias("has_year_header"))
    return continued_tables(tables).select("doc", "place", "first_page", "table_no", "start")


@registry.add("packed_paragraphs")
def packed_paragraphs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into chunks of 2,800 characters with 250 of overlap."""
    d = read(spark, sf_dir, "documents")
    return packed_paragraphs(d.select(F.col("doc_id").cast("string").alias("doc"), F.coalesce("lang", F.lit("")).alias("section"), "text"))


#: How headings of narrative sections begin, and what ends the narrative.
SECTIONS = {
    "Management Discussion & Analysis": ("management discussion", "management s discussion and analysis", "md a"),
    "Business Review": ("business review", "review of operations", "operational review", "operating review", "performance review"),
    "Directors Report": ("directors report", "report of the directors", "report of the board of directors"),
    "CEO Review": ("ceo review", "ceo s review", "ceo s message", "ceo message", "message from the ceo", "chief executive s review", "chief executive officer s review", "chief executive s message", "president s review", "president s message"),
    "Chairman Review": ("chairman review", "chairman s review", "chairman s message", "chairman s statement", "chairman statement", "message from the chairman"),
    "Outlook": ("outlook", "future outlook", "future prospects"),
    "Financial Review": ("financial review", "financial performance review"),
    "Risks": ("principal risks", "risk management", "risks and opportunities", "risk"),
    "Opportunities": ("opportunities",),
    "Strategy": ("our strategy", "strategy", "strategic"),
    "Sustainability": ("sustainability", "esg", "environmental social"),
}
ENDS = (
    "independent auditor", "auditor's report", "auditors' report", "notes to the financial statements", "notes to the unconsolidated", "notes to the consolidated", "statement of financial position", "statement of profit or loss", "statement of cash flows",
    "statement of changes in equity", "pattern of shareholding", "pattern of holding", "notice of annual general meeting", "form of proxy", "proxy form", "corporate information", "corporate calendar",
)


def narrative_pages(pages: DataFrame, sections: dict[str, tuple[str, ...]] = SECTIONS, ends: tuple[str, ...] = ENDS, heading: int = 70, letters: int = 120, digits: float = 0.35) -> DataFrame:
    """(doc, page, section, text) of the prose pages (doc, page, text) that a narrative section covers.

    A page whose first line, or first two, begins like a heading of a section, in at most `heading`
    characters without case and punctuation, begins that section, the first in the list winning; one
    that names what ends a narrative, or begins with a short line mostly of capitals, ends it; others
    go on. Pages with fewer than `letters` letters, or more than that share of digits, are no prose.
    """
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\r\n|[\n\r]"), lambda x: F.trim(x)), lambda x: x != "")
    p = pages.withColumn("lines__", F.slice(lines, 1, 2))
    plain = lambda x: F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))
    first, both = F.get("lines__", F.lit(0)), F.array_join("lines__", " ")
    section = F.lit(None).cast("string")
    for candidate in (both, first):  # the first line comes before both
        text, found = plain(candidate), F.lit(None).cast("string")
        for name, aliases in reversed(sections.items()):
            found = F.when(text.rlike("^(?:" + "|".join(aliases) + ")"), name).otherwise(found)
        section = F.coalesce(F.when(F.length(text).between(1, heading), found), section)
    capitals, every = F.length(F.regexp_replace(first, r"[^\p{Lu}]", "")), F.length(F.regexp_replace(first, r"[^\p{L}]", ""))
    is_heading = F.coalesce((F.length(first) <= heading) & (every >= 3) & (capitals >= 0.7 * every), F.lit(False))
    low = F.lower(F.coalesce("text", F.lit("")))
    is_end = F.exists(F.array(*map(F.lit, ends)), lambda e: F.contains(low, e))
    event = F.when(section.isNotNull(), section).when(is_end | is_heading, "")
    n_letters, n_digits = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}]", "")), F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{Nd}]", ""))
    prose = (n_letters >= letters) & (n_digits <= digits * (n_letters + n_digits))
    carried = F.last("event", ignorenulls=True).over(W.partitionBy("doc").orderBy("page"))
    rows = p.select("doc", "page", "text", event.alias("event"), prose.alias("prose")).withColumn("section", carried)
    return rows.where("section <> '' AND prose").select("doc", "page", "section", "text")


@registry.add(
    "narrative_pages",
    """WITH d AS (SELECT source AS doc, doc_id AS page, CASE doc_id % 6 WHEN 0 THEN 'Future Outlook' || chr(10) WHEN 1 THEN 'NOTES AND RATIOS' || chr(10) WHEN 2 THEN 'Chairman''s' || chr(10) || 'Review' || chr(10) ELSE 'going on as the pages before it did, ' END || coalesce(text, '') AS text, doc_id % 6 AS k FROM documents WHERE source IS NOT NULL),
    e AS (SELECT *, CASE k WHEN 0 THEN 'Outlook' WHEN 1 THEN '' WHEN 2 THEN 'Chairman Review' END AS event, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS letters, length(regexp_replace(text, '[^\\p{Nd}]', '', 'g')) AS digits FROM d),
    c AS (SELECT *, last_value(event IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page) AS section FROM e) SELECT doc, page, section FROM c WHERE section <> '' AND letters >= 120 AND digits <= 0.35 * (letters + digits)""",
)
def narrative_pages_query(spark, sf_dir):
    """Documents of a source as pages of one report, a third of them with headings."""
    d, k = read(spark, sf_dir, "documents").where("source IS NOT NULL"), F.col("doc_id") % 6
    head = F.when(k == 0, "Future Outlook\n").when(k == 1, "NOTES AND RATIOS\n").when(k == 2, "Chairman's\nReview\n").otherwise("going on as the pages before it did, ")
    return narrative_pages(d.select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.concat(head, F.coalesce("text", F.lit(""))).alias("text"))).select("doc", "page", "section")
