"""Base views: block, word, span and footer tables derived from the stored tables.

Each view has a DataFrame form and the DuckDB SQL of the same rows (``SQL``), so a query
and the SQL it is held against start from one definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, line: the lines of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


_K = "(doc_id * 31 + line_no * 17) % 20"


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed blocks: each line of ``documents`` plays a part that depends on its place."""
    found = lines(spark, sf_dir).withColumn("k", F.expr(f"cast({_K} as int)"))
    found = found.withColumn("k", F.when(F.col("line_no") == 0, 0).otherwise(F.col("k")))
    kind = (
        F.when(F.col("k") <= 3, "heading").when(F.col("k") <= 7, "list_item").when(F.col("k") <= 9, "table")
        .when(F.col("k") <= 11, "list_item").when(F.col("k") == 12, "note_header").when(F.col("k") == 13, "figure")
        .when(F.col("k") == 14, "code_block").otherwise("paragraph")
    )
    return found.select(
        "doc_id", F.col("line_no").alias("seq"), kind.alias("type"),
        F.when(F.col("k") <= 1, 1).when(F.col("k") == 2, 2).when(F.col("k") == 3, 3).otherwise(0).alias("level"),
        F.when(F.col("k").between(4, 7), "numbered").when(F.col("k").between(10, 11), "bullet").alias("list_kind"),
        F.lit(None).cast("string").alias("note_type"), F.col("line").alias("text"),
        F.when(F.col("k").between(8, 9), F.array(F.split("line", " "), F.array(F.lit("x"), F.lit("y")))).alias("rows"),
    )


def words(spark: SparkSession, sf_dir: str, by_page: bool = False) -> DataFrame:
    """Positioned words: each line of ``documents`` set from left to right, 50 lines a page.

    With ``by_page`` whole lines are dealt by page first, so that words, which take several times
    their room, are moved no more while all that follows is keyed by page.
    """
    found = lines(spark, sf_dir).withColumn("page_no", F.expr("cast(line_no div 50 as int)"))
    found = found.repartition("doc_id", "page_no") if by_page else found
    found = found.select("doc_id", "page_no", "line_no", F.posexplode(F.split("line", " ")).alias("word_seq", "text")).where("text <> ''")
    found = found.withColumn("k", F.expr(f"cast({_K} as int)"))
    order = Window.partitionBy("doc_id", "page_no", "line_no").orderBy("word_seq")
    end = F.sum(6 * F.length("text") + 3).over(order)
    size = F.when(F.col("k") <= 1, 18.0).when(F.col("k") == 2, 14.5).when(F.col("k") == 3, 13.6).when(F.col("k") == 4, 12.0).when(F.col("k") == 5, 9.0).otherwise(11.0)
    style = (F.col("word_seq") + F.col("k")) % 9
    font = F.when((F.col("k") <= 4) | (style == 0), "Arial-BoldMT").when(style == 3, "Arial-ItalicMT").when(style == 5, "Arial-BoldItalicMT").otherwise("ArialMT")
    return found.select(
        "doc_id", "page_no", "line_no", "word_seq", "text",
        (end - 6 * F.length("text") - 3).cast("double").alias("x0"), (end - 3).cast("double").alias("x1"),
        (F.lit(14.3) * (F.col("line_no") % 50)).alias("top"), size.alias("size"), font.alias("fontname"), "k",
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks on pages, from ``events``: a user's events are five pages; whole y, x0, width, height, an ordinal."""
    found = table(spark, sf_dir, "events")
    minute = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60)
    return found.select(
        F.col("event_id").cast("long").alias("id"), F.expr("cast(user_id div 5 as long)").alias("doc_id"), F.expr("cast(user_id % 5 as int)").alias("page_no"), minute.alias("y"),
        F.col("event_type").alias("kind"), F.col("value").cast("double").alias("width"), F.expr("cast(event_id % 200 as double)").alias("x0"), F.expr("cast(event_id % 9 as double)").alias("height"),
    )


def footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page footers, from ``orders``: a customer is a document, an order a page."""
    orders = table(spark, sf_dir, "orders")
    page = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    month = F.when(F.col("o_orderkey") % 7 != 0, F.date_format("o_orderdate", "MMMM yyyy"))
    return orders.select(F.col("o_custkey").cast("long").alias("doc_id"), page.alias("page_no"), month.alias("month_year"), F.lit(True).alias("has_signal"))


SQL = {
    "v_lines": r"""v_lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as line_no from documents)""",
    "v_blocks": r"""v_keyed as (
  select *, case when line_no = 0 then 0 else (doc_id * 31 + line_no * 17) % 20 end as k from v_lines),
v_blocks as (
  select doc_id, line_no as seq,
    case when k <= 3 then 'heading' when k <= 7 then 'list_item' when k <= 9 then 'table' when k <= 11 then 'list_item'
      when k = 12 then 'note_header' when k = 13 then 'figure' when k = 14 then 'code_block' else 'paragraph' end as type,
    case when k <= 1 then 1 when k = 2 then 2 when k = 3 then 3 else 0 end as level,
    case when k between 4 and 7 then 'numbered' when k between 10 and 11 then 'bullet' end as list_kind,
    cast(null as varchar) as note_type, line as text, case when k between 8 and 9 then [string_split(line, ' '), ['x', 'y']] end as rows
  from v_keyed)""",
    "v_words": r"""v_tokens as (
  select doc_id, line_no, unnest(string_split(line, ' ')) as text, unnest(range(len(string_split(line, ' ')))) as word_seq from v_lines),
v_words as (
  select doc_id, cast(line_no // 50 as int) as page_no, line_no, word_seq, text, cast(e - 6 * length(text) - 3 as double) as x0, cast(e - 3 as double) as x1,
    14.3::double * (line_no % 50) as top,
    case when k <= 1 then 18.0 when k = 2 then 14.5 when k = 3 then 13.6 when k = 4 then 12.0 when k = 5 then 9.0 else 11.0 end::double as size,
    case when k <= 4 or (word_seq + k) % 9 = 0 then 'Arial-BoldMT' when (word_seq + k) % 9 = 3 then 'Arial-ItalicMT'
      when (word_seq + k) % 9 = 5 then 'Arial-BoldItalicMT' else 'ArialMT' end as fontname, k
  from (select *, (doc_id * 31 + line_no * 17) % 20 as k,
      sum(6 * length(text) + 3) over (partition by doc_id, line_no order by word_seq) as e from v_tokens where text <> ''))""",
    "v_spans": r"""v_spans as (
  select cast(event_id as bigint) as id, cast(user_id // 5 as bigint) as doc_id, cast(user_id % 5 as int) as page_no, cast(floor(epoch(ts) / 60) as bigint) as y,
    event_type as kind, cast(value as double) as width, (event_id % 200)::double as x0, (event_id % 9)::double as height from events)""",
    "v_footers": r"""v_footers as (
  select cast(o_custkey as bigint) as doc_id, row_number() over (partition by o_custkey order by o_orderkey) as page_no,
    case when o_orderkey % 7 <> 0 then strftime(o_orderdate, '%B %Y') end as month_year, true as has_signal from orders)""",
}


def with_views(names: str, rest: str, recursive: bool = False) -> str:
    """SQL that defines the named views (and what they need) before ``rest``."""
    needs = {"v_blocks": ["v_lines"], "v_words": ["v_lines"]}
    order: list[str] = []
    for name in names.split():
        for x in [*needs.get(name, []), name]:
            if x not in order:
                order.append(x)
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(SQL[x] for x in order) + (",\n" if rest.lstrip()[:6].lower() != "select" else "\n") + rest.strip()


def literal(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(name: str, schema: str, rows: list[tuple]) -> str:
    """The rows of ``literal`` as a common table expression for DuckDB."""
    types = {"long": "bigint", "int": "integer", "string": "varchar", "double": "double", "boolean": "boolean", "array<array<string>>": "varchar[][]", "array<string>": "varchar[]"}
    columns = [c.strip().split(" ", 1) for c in schema.split(", ")]

    def sql(x: object) -> str:
        if x is None:
            return "null"
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, list):
            return "[" + ", ".join(map(sql, x)) + "]"
        return "'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else repr(x)

    body = ", ".join("(" + ", ".join(sql(x) for x in row) + ")" for row in rows)
    names = ", ".join(c for c, _ in columns)
    casts = ", ".join(f"cast({c} as {types[t]}) as {c}" for c, t in columns)
    return f"{name} as (select {casts} from (values {body}) t({names}))"
