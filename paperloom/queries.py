"""Queries over the driver's tables, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import evaluation as V
from .operators import fidelity as E
from .operators import markdown as M
from .operators import package as P
from .operators import workbook as X
from .plans import synthetic as S
from .sources import workbook as B

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- workbooks ------------------------------------------------------------------------------------------------------------


@query("SELECT n_regionkey::VARCHAR AS workbook, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::INTEGER AS row_no, n_nationkey::DOUBLE AS n_key, n_name FROM nation")
def xlsx_roundtrip_nation(spark: SparkSession, d: str) -> DataFrame:
    n = S.numbered(table(spark, d, "nation"), "n_regionkey", "n_nationkey")
    books = S.workbooks(n.select(F.col("n_regionkey").cast("string").alias("workbook"), F.col("k").alias("row"), S.line(F.col("n_nationkey"), F.col("n_name")).alias("values")), "is")
    cells = X.cells(B.facts(books, assets=False))
    return cells.groupBy("workbook", F.col("row").alias("row_no")).agg(F.max(F.when(F.col("col") == 1, F.col("value_num"))).alias("n_key"), F.max(F.when(F.col("col") == 2, F.col("value"))).alias("n_name"))


flagship = xlsx_roundtrip_nation


@query("SELECT o_custkey::VARCHAR AS workbook, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey")
def xlsx_roundtrip_orders(spark: SparkSession, d: str) -> DataFrame:
    o = S.numbered(table(spark, d, "orders"), "o_custkey", "o_orderkey")
    books = S.workbooks(o.select(F.col("o_custkey").cast("string").alias("workbook"), F.col("k").alias("row"), S.line(F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_totalprice")).alias("values")), "isd")
    return X.cells(B.facts(books, assets=False)).filter("col = 3").groupBy("workbook").agg(F.count("*").alias("n_orders"), F.round(F.sum("value_num"), 2).alias("total"))


def _header_split(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey")
    head = c.select("n_regionkey", "c_nationkey").distinct().select("n_regionkey", "c_nationkey", F.lit(None).cast("long").alias("c_custkey"), F.array(F.lit("name"), F.lit("segment"), F.lit("key")).alias("values"))
    rows = c.select("n_regionkey", "c_nationkey", "c_custkey", S.line(F.col("c_name"), F.col("c_mktsegment"), F.col("c_custkey")).alias("values")).unionByName(head)
    rows = S.numbered(rows, "n_regionkey", "c_nationkey", F.asc_nulls_first("c_custkey"), name="row")
    return X.tables(B.facts(S.workbooks(rows.select(F.col("n_regionkey").cast("string").alias("workbook"), "row", "values"), "ssi")))


@query("""
WITH g AS (SELECT n_regionkey AS w, n_nationkey AS n, count(*) + 1 AS rows FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
t AS (SELECT w, n, rows, row_number() OVER (PARTITION BY w ORDER BY n) AS k, count(*) OVER (PARTITION BY w) AS m, sum(rows) OVER (PARTITION BY w ORDER BY n) AS last FROM g)
SELECT w::VARCHAR AS workbook, k::INTEGER AS table_no, m AS table_of, (last - rows + 1)::INTEGER AS start_row, last::INTEGER AS end_row, rows::INTEGER AS row_count, CASE WHEN k < m THEN 'header_repeat' ELSE '' END AS signals FROM t""")
def xlsx_header_split(spark: SparkSession, d: str) -> DataFrame:
    return _header_split(spark, d).select("workbook", "table_no", "table_of", "start_row", "end_row", "row_count", F.array_join("boundary_signals", ",").alias("signals"))


def _gapped(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers by region: a blank row after a nation's first supplier, and two between nations. (region, nation, row, values)"""
    s = table(spark, d, "supplier").join(table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey"), "s_nationkey")
    s = S.numbered(s, "s_nationkey", "s_suppkey", name="i")
    size = s.groupBy("n_regionkey", "s_nationkey").agg((F.max("i") + F.when(F.max("i") > 1, 1).otherwise(0) + 2).alias("size"))
    start = size.withColumn("base", F.sum("size").over(Window.partitionBy("n_regionkey").orderBy("s_nationkey")) - F.col("size"))
    row = (F.col("base") + F.col("i") + F.when(F.col("i") > 1, 1).otherwise(0)).cast("int")
    return s.join(start, ["n_regionkey", "s_nationkey"]).select(F.col("n_regionkey").cast("string").alias("workbook"), "s_nationkey", row.alias("row"), S.line(F.col("s_suppkey"), F.col("s_name")).alias("values"))


_GAPS = """
WITH s AS (SELECT n_regionkey AS w, s_nationkey AS n, count(*) AS n_rows FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
t AS (SELECT w, n, n_rows, n_rows + (n_rows > 1)::INTEGER AS span, row_number() OVER (PARTITION BY w ORDER BY n) AS k, sum(n_rows + (n_rows > 1)::INTEGER + 2) OVER (PARTITION BY w ORDER BY n) AS upto FROM s),
b AS (SELECT w::VARCHAR AS workbook, k::INTEGER AS table_no, (upto - span - 1)::INTEGER AS start_row, (upto - 2)::INTEGER AS end_row, n_rows::INTEGER AS row_count FROM t)
"""


@query(f"{_GAPS} SELECT * FROM b")
def xlsx_blank_gap_split(spark: SparkSession, d: str) -> DataFrame:
    return X.tables(B.facts(S.workbooks(_gapped(spark, d).drop("s_nationkey"), "is"))).select("workbook", "table_no", "start_row", "end_row", "row_count")


@query(f"{_GAPS}, m AS (SELECT workbook, start_row AS m0, end_row + 3 AS m1 FROM b) SELECT workbook, table_no, count(*) AS n_merges FROM b JOIN m USING (workbook) WHERE m0 <= end_row AND m1 >= start_row GROUP BY workbook, table_no")
def xlsx_merged_overlap(spark: SparkSession, d: str) -> DataFrame:
    def merges(at: list[int]) -> list[str]:
        starts = [r for k, r in enumerate(at) if not k or r - at[k - 1] >= 3]
        last = [at[k - 1] for k, r in enumerate(at) if k and r - at[k - 1] >= 3] + at[-1:]
        return [f"A{a}:B{b + 3}" for a, b in zip(starts, last, strict=True)]

    facts = B.facts(S.workbooks(_gapped(spark, d).drop("s_nationkey"), "is", merges=merges))
    return X.in_tables(X.tables(facts), X.merged(facts), "first_row", "last_row").groupBy("workbook", "table_no").agg(F.count("*").alias("n_merges"))


@query("SELECT p_brand AS workbook, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)::INTEGER AS row_no, p_partkey::VARCHAR AS v0, p_name AS v1, p_size::VARCHAR AS v2, 3 AS width FROM part")
def xlsx_prune(spark: SparkSession, d: str) -> DataFrame:
    p = S.numbered(table(spark, d, "part"), "p_brand", "p_partkey")
    books = S.workbooks(p.select(F.col("p_brand").alias("workbook"), F.col("k").alias("row"), S.line(F.col("p_partkey"), F.lit(None), F.col("p_name"), F.lit(""), F.col("p_size")).alias("values")), "issss")
    r = X.tables(B.facts(books)).select("workbook", F.posexplode("rows").alias("k", "r"))
    return r.select("workbook", (F.col("k") + 1).alias("row_no"), *(F.get("r", F.lit(i)).alias(f"v{i}") for i in range(3)), F.size("r").alias("width"))


@query("SELECT l_suppkey::VARCHAR AS workbook, row_no, '=C' || row_no || '*(1-D' || row_no || ')' AS formula, l_extendedprice * (1 - l_discount) AS cached FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount)::INTEGER AS row_no FROM lineitem)")
def xlsx_cell_metadata(spark: SparkSession, d: str) -> DataFrame:
    li = S.numbered(table(spark, d, "lineitem"), "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount")
    values = S.line(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_extendedprice"), F.col("l_discount"), F.col("l_extendedprice") * (1 - F.col("l_discount")))
    books = S.workbooks(li.select(F.col("l_suppkey").cast("string").alias("workbook"), F.col("k").alias("row"), values.alias("values")), "iiddd", formula=(4, "C{r}*(1-D{r})"))
    return X.cell_metadata(B.facts(books, assets=False)).filter("formula is not null").select("workbook", F.col("row").alias("row_no"), "formula", F.col("value_num").alias("cached"))


@query("SELECT c_nationkey AS doc_id, '| name | key |\n| --- | --- |\n' || string_agg('| ' || c_name || '\\| | ' || c_custkey || ' |', '\n' ORDER BY c_custkey) AS content FROM customer GROUP BY c_nationkey")
def xlsx_markdown_render(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("c_custkey", S.line(F.concat("c_name", F.lit(" |")), F.col("c_custkey")).alias("r")))).alias("rows"))
    body = F.concat(F.array(F.array(F.lit("name"), F.lit("key"))), F.transform("rows", lambda x: x["r"]))
    return rows.select("doc_id", F.replace(F.array_join(T.markdown_table(body), "\n"), F.lit(" \\|"), F.lit("\\|")).alias("content"))


@query()
def xlsx_workbook_markdown(spark: SparkSession, d: str) -> DataFrame:
    n = _gapped(spark, d).drop("s_nationkey")
    return X.markdown(B.facts(S.workbooks(n, "is")), F.concat("workbook", F.lit(".xlsx")))


@query()
def xlsx_table_json(spark: SparkSession, d: str) -> DataFrame:
    return X.table_json(B.facts(S.workbooks(_gapped(spark, d).drop("s_nationkey"), "is")))


# ---- document packages ----------------------------------------------------------------------------------------------------


def _supplied(spark: SparkSession, d: str) -> DataFrame:
    """A DOCX a nation with a text attachment a supplier, the greatest key first."""
    s = S.numbered(table(spark, d, "supplier"), "s_nationkey", F.desc("s_suppkey"))
    return S.documents(s.select("s_nationkey", "k", F.concat(F.lit("s"), "s_suppkey", F.lit(".txt")).alias("name"), F.col("s_name").alias("text"), F.col("s_name").cast("binary").alias("payload")), "s_nationkey")


_SUPPLIED = """
WITH s AS (SELECT s_nationkey::VARCHAR AS doc_id, s_suppkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey DESC) AS k, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier),
a AS (SELECT doc_id, k::INTEGER AS position, format('attachment_{:02d}', k) AS ref, 'attachment' AS kind, 's' || s_suppkey || '.txt' AS filename, s_name AS payload, format('p_{:04d}', k + 1) AS block_id, s_name AS paragraph,
  format('[s{}.txt](resources/attachment_{:02d}/preview.md)', s_suppkey, k) AS reference FROM s
  UNION ALL SELECT doc_id, (n + 1)::INTEGER, 'image_01', 'image', 'logo.png', 'PNG ' || doc_id, NULL, NULL, '![](assets/images/image_01.png)' FROM s WHERE k = 1)
"""


@query(f"{_SUPPLIED} SELECT doc_id, position, ref, kind, filename, strlen(payload) AS size_bytes, sha256(payload) AS sha256 FROM a")
def docx_assets_numbering(spark: SparkSession, d: str) -> DataFrame:
    return P.found(P.assets(_supplied(spark, d), payloads=False)).select("doc_id", "position", "ref", "kind", "filename", "size_bytes", "sha256")


@query(f"{_SUPPLIED} SELECT doc_id, ref, block_id, paragraph AS paragraph_text FROM a WHERE block_id IS NOT NULL")
def docx_anchors(spark: SparkSession, d: str) -> DataFrame:
    return P.found(P.assets(_supplied(spark, d), payloads=False)).filter("anchor is not null").select("doc_id", "ref", "anchor.block_id", "anchor.paragraph_text")


@query(f"{_SUPPLIED} SELECT doc_id, 'Items\n\n' || string_agg(coalesce(paragraph, '') || reference, '\n\n' ORDER BY position) || '\n' AS content FROM a GROUP BY doc_id")
def docx_body_markdown(spark: SparkSession, d: str) -> DataFrame:
    return P.parse_main(_supplied(spark, d), "native").select("doc_id", "content")


@query(f"""{_SUPPLIED} SELECT doc_id, position, ref, kind, filename, CASE kind WHEN 'image' THEN 'png' ELSE 'txt' END AS type, 'word/' || CASE kind WHEN 'image' THEN 'media/' ELSE 'embeddings/' END || filename AS source_path, reference AS markdown_reference,
  CASE kind WHEN 'image' THEN 'structured/assets/images/image_01.png' ELSE 'structured/resources/' || ref || '/preview.md' END AS target_path, CASE kind WHEN 'image' THEN '' ELSE 'structured/resources/' || ref || '/preview.md' END AS entry_point, '' AS tables FROM a""")
def docx_position_map(spark: SparkSession, d: str) -> DataFrame:
    return P.position_map(P.assets(_supplied(spark, d), payloads=False))


@query(f"{_SUPPLIED} SELECT doc_id, 'success' AS parse_status, count_if(kind = 'attachment') AS embedded_objects, count_if(kind = 'image') AS images, 0::BIGINT AS charts, strlen('Items\n\n' || string_agg(coalesce(paragraph, '') || reference, '\n\n' ORDER BY position) || '\n')::INTEGER AS content_bytes FROM a GROUP BY doc_id")
def manifest_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = _supplied(spark, d)
    m = P.manifests(P.assets(docs, payloads=False), P.parse_main(docs, "native"))
    s = "content_stats"
    return m.select("doc_id", "parse_status", F.col(f"{s}.embedded_object_count").alias("embedded_objects"), F.col(f"{s}.image_count").alias("images"), F.col(f"{s}.chart_count").alias("charts"), F.col(f"{s}.content_md_bytes").alias("content_bytes"))


@query()
def docx_child_files(spark: SparkSession, d: str) -> DataFrame:
    return P.child_files(P.assets(_supplied(spark, d), payloads=False))


@query()
def docx_resource_index(spark: SparkSession, d: str) -> DataFrame:
    return P.resource_entries(P.assets(_supplied(spark, d), payloads=False))


@query("""
WITH t AS (SELECT conv_id::VARCHAR AS doc_id, turn, role, min(turn) OVER (PARTITION BY conv_id, role) AS first FROM conversations)
SELECT doc_id, format('attachment_{:02d}', row_number() OVER (PARTITION BY doc_id ORDER BY turn)) AS ref, format('t{:09d}.txt', turn) AS filename, sha256(role) AS sha256 FROM t WHERE turn = first""")
def docx_scan_dedup(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", F.format_string("t%09d.txt", "turn").alias("name"), F.col("role").cast("binary").alias("payload"))
    return P.found(P.assets(S.scanned(c, "conv_id"), payloads=False)).select("doc_id", "ref", "filename", "sha256")


@query("SELECT doc_id::VARCHAR AS doc_id, 'd' || doc_id || '.txt' AS filename, 'text/plain' AS detected_mime, strlen(text) AS size_bytes, sha256(text) AS sha256 FROM documents WHERE text <> ''")
def ole_unwrap(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text <> ''").select("doc_id", F.concat(F.lit("d"), "doc_id", F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("payload"))
    return P.found(P.assets(S.ole(docs), payloads=False)).select("doc_id", "filename", "detected_mime", "size_bytes", "sha256")


@query("""SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN 'application/zip' WHEN 4 THEN 'text/csv' ELSE 'x/declared' END AS mime FROM part""")
def mime_sniff(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_size") % 6
    heads = ["255044462D31", "89504E470D0A1A0A00", "FFD8FFE0", "504B030414"]
    data = F.coalesce(*(F.when(k == i, F.concat(F.unhex(F.lit(h)), F.col("p_name").cast("binary"))) for i, h in enumerate(heads)), F.col("p_name").cast("binary"))
    name = F.when(k == 4, "x.csv").otherwise("x.unknown")
    return table(spark, d, "part").select("p_partkey", T.mime(name, data, F.lit("x/declared"), F.lit(False)).alias("mime"))


@query("SELECT doc_id, least(strlen(text), 102400) AS shown_bytes, strlen(text) > 102400 AS truncated FROM documents")
def text_preview(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("payload"))
    shown = F.substring("payload", 1, 102400)
    return docs.select("doc_id", F.octet_length(shown).cast("long").alias("shown_bytes"), (F.octet_length("payload") > 102400).alias("truncated"), T.utf8_lenient(shown).alias("text")).drop("text")


@query("SELECT conv_id::VARCHAR AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS sequence, 'footnote' AS kind, role || ' ' || turn AS text FROM conversations")
def docx_notes(spark: SparkSession, d: str) -> DataFrame:
    c = S.numbered(table(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "k", "text", F.concat_ws("  ", "role", "turn").alias("note"))
    return P.notes(S.noted(c, "conv_id")).select("doc_id", "sequence", "kind", "text")


@query("SELECT n_regionkey::VARCHAR AS doc_id, 1 AS n_tables, count(*)::INTEGER AS table_rows, count(*)::INTEGER AS n_nested, 3 * count(*) AS nested_cols FROM nation GROUP BY n_regionkey")
def gt_tables_depth(spark: SparkSession, d: str) -> DataFrame:
    n = S.numbered(table(spark, d, "nation"), "n_regionkey", "n_nationkey")
    gt = P.groundtruth(S.nested(n.select("n_regionkey", "k", S.line(F.col("n_nationkey"), F.col("n_name"), F.lit("x")).alias("cells")), "n_regionkey"))
    e = gt.select("doc_id", F.from_json("expected", E.EXPECTED).alias("e"))
    return e.select("doc_id", F.size("e.tables").alias("n_tables"), F.get("e.tables", F.lit(0))["rows"].alias("table_rows"), F.size("e.nested_tables").alias("n_nested"), F.aggregate("e.nested_tables", F.lit(0).cast("long"), lambda a, t: a + t["cols"]).alias("nested_cols"))


# ---- text and Markdown ----------------------------------------------------------------------------------------------------

_WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query(f"SELECT doc_id, md5(trim(regexp_replace(text, '{_WS}', ' ', 'g'))) AS digest FROM documents")
def whitespace_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.collapse(F.col("text")).cast("binary")).alias("digest"))


@query("SELECT page_id, md5(regexp_replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS digest FROM pages")
def html_strip_unescape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(T.plain_html_col(F.col("html")).cast("binary")).alias("digest"))


@query("SELECT page_id, regexp_replace(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1), '^\\s+|\\s+$', '', 'g') AS title FROM pages WHERE regexp_matches(html, '<h1[^>]*>[^<]*\\S[^<]*</h1>')")
def html_headings(spark: SparkSession, d: str) -> DataFrame:
    md = F.concat(F.lit("# "), F.regexp_replace(F.regexp_extract("html", r"<h1[^>]*>([^<]*)</h1>", 1), r"\s+$|^\s+", ""), F.lit("\n\ntext"))
    return M.headings(M.lines(table(spark, d, "pages").withColumn("md", md), "md", "page_id"), "page_id").select("page_id", F.col("text").alias("title"))


@query("""
WITH n AS (SELECT n_regionkey AS r, n_nationkey AS n, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
h AS (SELECT r AS doc_id, r AS o0, -1 AS o1, -1 AS o2, 1 AS level, r_name AS text, '' AS parents FROM n GROUP BY r, r_name
  UNION ALL SELECT r, r, n, -1, 2, n_name, r_name FROM n
  UNION ALL SELECT r, r, n, c_custkey, 3, c_name, r_name || ' > ' || n_name FROM n JOIN customer ON c_nationkey = n)
SELECT doc_id, (2 * row_number() OVER (PARTITION BY doc_id ORDER BY o1, o2) - 2)::INTEGER AS line_no, level, text, parents FROM h""")
def markdown_headings_tree(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    one = lambda o1, o2, level, text: F.struct(o1.cast("long").alias("o1"), o2.cast("long").alias("o2"), F.concat(F.lit("#" * level + " "), text).alias("t"))
    none = F.lit(-1)
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    h = n.select("n_regionkey", one(none, none, 1, F.col("r_name")).alias("h")).distinct().unionByName(n.select("n_regionkey", one(F.col("n_nationkey"), none, 2, F.col("n_name")).alias("h"))).unionByName(c.select("n_regionkey", one(F.col("n_nationkey"), F.col("c_custkey"), 3, F.col("c_name")).alias("h")))
    docs = h.groupBy(F.col("n_regionkey").alias("doc_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("h")), lambda x: x["t"]), "\n\n").alias("content"))
    return M.parents(M.headings(M.lines(docs, "content", "doc_id"), "doc_id"), "doc_id").select("doc_id", "line_no", "level", "text", F.array_join("parents", " > ").alias("parents"))


def _rendered(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """Customers of a nation as a table of a kind, in a text of its own: (doc_id, method, content)."""
    name, key = F.col("c_name"), F.col("c_custkey").cast("string")
    pad = lambda c, n: F.rpad(c, n, " ")
    row, head, foot, between = {
        "pipe": (F.concat(F.lit("| "), name, F.lit(" | "), key, F.lit(" |")), "| name | key |\n|---|:-:|\n", "\n\nend", "\n"),
        "grid": (F.concat(F.lit("| "), pad(name, 20), F.lit("| "), pad(key, 12), F.lit("|\n+---------------------+-------------+")), "+---------------------+-------------+\n| name                | key         |\n+=====================+=============+\n", "\n\nend", "\n"),
        "simple": (F.concat(F.lit("  "), pad(name, 20), F.lit("  "), key), "  name                  key\n  --------------------  ------------\n", "\n  --------------------  ------------\n\nend", "\n"),
        "html": (F.concat(F.lit("<tr><td><b>"), name, F.lit("</b></td><td>"), key, F.lit(" </td></tr>")), "<table class='x'><tr><th>name</th><th>key</th></tr>", "</table>\n\nend", ""),
    }[kind]
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("string").alias("doc_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", row.alias("r")))), lambda x: x["r"]), between).alias("rows"))
    return c.select("doc_id", F.lit("m").alias("method"), F.concat(F.lit("start\n\n" + head), "rows", F.lit(foot)).alias("content"))


def _parse(kind: str) -> None:
    cells = """SELECT c_nationkey::VARCHAR AS doc_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)::INTEGER AS row_idx, c_name, c_custkey::VARCHAR AS c_key, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer"""
    sql = f"""WITH c AS ({cells}) SELECT doc_id, 0 AS table_idx, (n + 1)::INTEGER AS n_rows, 2 AS n_cols, row_idx, c_name AS c0, c_key AS c1 FROM c UNION ALL SELECT DISTINCT doc_id, 0, (n + 1)::INTEGER, 2, 0, 'name', 'key' FROM c"""

    def run(spark: SparkSession, d: str) -> DataFrame:
        t = M.tables(_rendered(spark, d, kind)).filter(F.col("parser") == ("pipe" if kind == "grid" else kind))
        r = t.select("doc_id", "table_idx", "n_rows", "n_cols", F.posexplode("cells").alias("row_idx", "r"))
        return r.select("doc_id", "table_idx", "n_rows", "n_cols", "row_idx", F.get("r", F.lit(0)).alias("c0"), F.get("r", F.lit(1)).alias("c1"))

    run.__name__ = f"{kind}_table_parse"
    query(sql)(run)


for _kind in ("pipe", "grid", "simple", "html"):
    _parse(_kind)


@query("SELECT p_partkey, 'word/media/' || p_partkey || '/a.png' AS path FROM part")
def path_resolve(spark: SparkSession, d: str) -> DataFrame:
    target = F.concat(F.lit("../x/../../media/./"), "p_partkey", F.lit("//a.png#frag"))
    return table(spark, d, "part").select("p_partkey", T.resolve(F.lit("word/sub/deep"), target).alias("path"))


_F1 = """
WITH p AS (SELECT p_partkey, p_name, lag(p_name) OVER (ORDER BY p_partkey) AS before FROM part),
w AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS g, list_distinct(string_split(before, ' ')) AS c FROM p WHERE before IS NOT NULL)
SELECT p_partkey, CASE WHEN len(list_intersect(g, c)) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(g, c)) / (len(g) + len(c)) END AS f1 FROM w"""


@query(_F1)
def token_f1(spark: SparkSession, d: str) -> DataFrame:
    # part keys are dense, so the row before is an equi-join: no window over one partition
    p = table(spark, d, "part").select("p_partkey", "p_name")
    before = p.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("p_name").alias("before"))
    return p.join(before, "p_partkey").select("p_partkey", E.token_f1(F.col("p_name"), F.col("before")).alias("f1"))


# ---- fidelity -------------------------------------------------------------------------------------------------------------

_SCORES = """
WITH c AS (SELECT c_custkey::VARCHAR AS doc_id, c_mktsegment AS method, c_custkey AS k FROM customer),
s AS (SELECT doc_id, method, d.dimension, CASE WHEN d.dimension = 'hyperlink_recall' THEN CASE WHEN k % 2 = 0 THEN 1.0 ELSE 0.0 END ELSE d.score END::DOUBLE AS score FROM c CROSS JOIN
  (VALUES ('table_recall', 1.0::DOUBLE), ('heading_recall', 1.0), ('heading_tree_score', 1.0), ('key_text_hit', 2.0::DOUBLE / 3), ('checkbox_recall', 0.5), ('hyperlink_recall', 0.0)) d(dimension, score))
"""


def _checks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    packages, expected = S.converted(table(spark, d, "customer"))
    return packages, expected, E.checks(packages, expected)


@query(f"{_SCORES} SELECT * FROM s")
def dimension_long_scores(spark: SparkSession, d: str) -> DataFrame:
    return E.scores(_checks(spark, d)[2]).select("doc_id", "method", "dimension", "score")


@query(f"{_SCORES} SELECT doc_id, method, round(avg(score), 9) AS doc_score FROM s GROUP BY doc_id, method")
def doc_score(spark: SparkSession, d: str) -> DataFrame:
    packages, expected, checks = _checks(spark, d)
    return E.doc_scores(E.scores(checks), packages, expected).withColumn("doc_score", F.round("doc_score", 9))


@query(f"{_SCORES}, m AS (SELECT doc_id, method, avg(score) AS doc_score FROM s GROUP BY doc_id, method) SELECT method, count(*) AS n_docs, printf('%.4f', avg(doc_score)) AS doc_score, (SELECT printf('%.4f', avg(score)) FROM s WHERE s.method = m.method AND dimension = 'hyperlink_recall') AS hyperlink_recall, '-' AS image_recall FROM m GROUP BY method")
def method_summary(spark: SparkSession, d: str) -> DataFrame:
    packages, expected, checks = _checks(spark, d)
    return E.wide_summary(E.doc_scores(E.scores(checks), packages, expected, E.DIMENSIONS)).select("method", "n_docs", *(E.formatted(F.col(c)).alias(c) for c in ("doc_score", "hyperlink_recall", "image_recall")))


@query(f"{_SCORES} SELECT doc_id, method, dimension, CASE dimension WHEN 'key_text_hit' THEN 'not in the text' WHEN 'checkbox_recall' THEN '□ ' || lower(method) ELSE 'url=https://x.org/none anchor=see' END AS miss FROM s WHERE score < 1")
def misses(spark: SparkSession, d: str) -> DataFrame:
    return E.misses(_checks(spark, d)[2]).select("doc_id", "method", "dimension", "miss")


@query("SELECT c_nationkey::VARCHAR AS doc_id, 'm' AS method, 0 AS table_idx, (1 - count_if(c_custkey % 2 = 1)::DOUBLE / (2 * (count(*) + 1))) AS ratio FROM customer GROUP BY c_nationkey")
def table_cell_match(spark: SparkSession, d: str) -> DataFrame:
    got = M.table_cells(M.tables(_rendered(spark, d, "pipe")))
    odd = F.when((F.col("col_idx") == 1) & (F.col("row_idx") > 0) & (F.col("cell").cast("long") % 2 == 1), F.lit("other")).otherwise(F.col("cell"))
    return E.cell_match(got.withColumn("cell", odd), got).withColumn("ratio", F.col("ratio").cast("double"))


# Of the 23 dimensions: those that an even supplier alone meets, those that are met by half, and those that are met.
_EVEN = ("nested_table_recall", "nested_table_asset_recall", "smartart_text_recall", "footnote_recall", "hyperlink_recall", "textbox_recall", "numbering_recall", "table_numbering_recall", "formula_recall")
_HALF = ("embedded_object_recall", "table_recall", "heading_recall", "heading_tree_score", "key_text_hit", "checkbox_recall", "chart_text_recall", "toc_recall", "table_cell_match", "embedded_content_hit")
_FULL = ("image_recall", "footnote_anchor_accuracy", "asset_anchor_accuracy", "markdown_portability")
_ALL = ", ".join(f"('{d}', {k})" for k, ds in enumerate((_EVEN, _HALF, _FULL)) for d in ds)


@query(f"SELECT s_suppkey::VARCHAR AS doc_id, dimension, CASE kind WHEN 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN 1.0 ELSE 0.0 END WHEN 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS score FROM supplier CROSS JOIN (VALUES {_ALL}) d(dimension, kind)")
def all_dimensions(spark: SparkSession, d: str) -> DataFrame:
    packages, expected = S.converted_in_full(table(spark, d, "supplier"))
    return E.scores(E.checks(packages, expected)).select("doc_id", "dimension", "score")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 THEN 0.75 ELSE 1.0 END::DOUBLE AS similarity FROM part")
def heading_level_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Gold levels 1, 2, 3, 2 against the same moved by up to two, of which every other part lacks the last."""
    gold = F.array(*map(F.lit, (1, 2, 3, 2)))
    moved = F.transform(gold, lambda x: x + (F.col("p_partkey") % 3).cast("int"))
    content = F.when(F.col("p_partkey") % 2 == 1, F.slice(moved, 1, 3)).otherwise(moved)
    return table(spark, d, "part").select("p_partkey", E.level_similarity(gold, content).alias("similarity"))


@query(f"SELECT s_suppkey::VARCHAR AS doc_id, dimension, count(*) AS n FROM supplier CROSS JOIN (VALUES {_ALL}) d(dimension, kind) WHERE kind = 1 OR kind = 0 AND s_suppkey % 2 = 1 GROUP BY ALL")
def all_misses(spark: SparkSession, d: str) -> DataFrame:
    packages, expected = S.converted_in_full(table(spark, d, "supplier"))
    return E.misses(E.checks(packages, expected)).groupBy("doc_id", "dimension").agg(F.count("*").alias("n"))


@query(f"""WITH s AS (SELECT s_suppkey, dimension, CASE kind WHEN 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN 1.0 ELSE 0.0 END WHEN 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS score FROM supplier CROSS JOIN (VALUES {_ALL}) d(dimension, kind))
SELECT s_suppkey::VARCHAR AS doc_id, 'm' AS method, {", ".join(f"printf('%.4f', max(score) FILTER (WHERE dimension = '{x}')) AS {x}" for x in E.DIMENSIONS)}, printf('%.4f', avg(score)) AS doc_score FROM s GROUP BY s_suppkey""")
def evaluation_results(spark: SparkSession, d: str) -> DataFrame:
    packages, expected = S.converted_in_full(table(spark, d, "supplier"))
    return V.wide_results(E.doc_scores(E.scores(E.checks(packages, expected)), packages, expected, E.DIMENSIONS))
