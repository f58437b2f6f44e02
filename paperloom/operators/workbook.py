"""Workbook operators: rows, sub-tables, pruning, metadata and Markdown, all native windows and joins over decoded facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

SHEET = ("workbook", "sheet_idx", "sheet", "state")
TABLE = ("workbook", "table_idx")


def cells(facts: DataFrame) -> DataFrame:
    return facts.filter("fact = 'cell'")


def _dense(at: str = "col", value: str = "value") -> Column:
    """Values of a group by column, with nulls in the gaps and none at the end."""
    pairs = F.map_from_entries(F.collect_list(F.struct(at, value)))
    return F.transform(F.sequence(F.lit(1), F.max(at)), lambda k: F.try_element_at(pairs, k))


def rows(facts: DataFrame) -> DataFrame:
    """SHEET, row, values: rows that hold a value, right-trimmed. Rows that are absent are blank."""
    return cells(facts).filter("value is not null").groupBy(*SHEET, "row").agg(_dense().alias("values"))


def is_blank(v: Column) -> Column:
    return v.isNull() | (v == "")


def boundaries(rows_: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """Non-blank rows with hdr (repeats a header), gap (follows two blank rows) and part (number of boundaries so far).

    A header is a row whose non-blank values occur at least three times in the sheet, two of them at least being no numbers.
    """
    sig = F.filter("values", lambda v: ~is_blank(v))
    sheet, ordered = Window.partitionBy("workbook", "sheet_idx"), Window.partitionBy("workbook", "sheet_idx").orderBy("row")
    r = rows_.withColumn("sig", sig).filter(F.size("sig") > 0)
    r = r.withColumn("same", F.count("*").over(Window.partitionBy("workbook", "sheet_idx", "sig")))
    r = r.withColumn("hdr", (F.col("same") >= 3) & (F.size(F.filter("sig", lambda v: ~T.looks_numeric(v))) >= 2))
    r = r.withColumn("gap", F.col("row") - F.lag("row", 1, 0).over(ordered) >= 3)
    r = r.withColumn("cut", (F.col("hdr") | F.col("gap")) & (F.col("row") > 1))
    r = r.withColumn("part", F.sum(F.col("cut").cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    if anchors is not None:
        r = r.join(anchors.select("workbook", "sheet_idx", F.col("row"), F.lit(True).alias("image")).distinct(), ["workbook", "sheet_idx", "row"], "left")
    else:
        r = r.withColumn("image", F.lit(False))
    return r.drop("sig", "same").withColumn("image", F.coalesce("image", F.lit(False))).withColumn("last_part", F.max("part").over(sheet))


def assets(facts: DataFrame) -> DataFrame:
    """Assets with `ref`, numbered by kind in the workbook, `cell` and 1-based `asset_row`."""
    a = facts.filter("fact = 'asset' and sha256 is not null or fact = 'asset' and kind = 'equation'").withColumn("seq", F.monotonically_increasing_id())
    n = F.row_number().over(Window.partitionBy("workbook", "kind").orderBy("seq"))
    at = F.when(F.col("from_row").isNotNull(), F.concat(T.column_letters(F.col("from_col") + 1), (F.col("from_row") + 1).cast("string")))
    return a.withColumn("ref_no", n).withColumn("asset_ref", F.format_string("%s_%02d", "kind", n)).withColumn("cell", at).withColumn("asset_row", F.col("from_row") + 1)


def tables(facts: DataFrame, with_assets: bool = True) -> DataFrame:
    """TABLE, SHEET, start_row, end_row (as far as the sheet's last asset), boundary_signals, rows (pruned), row_count, table_no, table_of."""
    anchored = assets(facts).filter("asset_row is not null").select("workbook", "sheet_idx", F.col("asset_row").alias("row")) if with_assets else None
    b = boundaries(rows(facts), anchored)
    signal = lambda c, name: F.when(F.col(c), F.lit(name))
    first = F.struct("row", F.array_compact(F.array(signal("hdr", "header_repeat"), signal("gap", "blank_row_gap"), signal("image", "image_anchor"))).alias("signals"))
    long = b.select(*SHEET, "part", "row", F.posexplode("values").alias("k", "v"))
    kept = long.filter(~is_blank(F.col("v"))).groupBy("workbook", "sheet_idx", "part").agg(F.sort_array(F.collect_set("k")).alias("kept"))
    t = b.groupBy(*SHEET, "part").agg(F.min("row").alias("start_row"), F.max("row").alias("end_row"), F.min(first).alias("first"), F.sort_array(F.collect_list(F.struct("row", "values"))).alias("raw"))
    t = t.join(kept, ["workbook", "sheet_idx", "part"])
    trim = lambda a: F.slice(a, 1, F.coalesce(F.array_max(F.transform(a, lambda v, k: F.when(v.isNotNull(), k + 1))), F.lit(0)))
    pruned = F.transform("raw", lambda r: trim(F.transform("kept", lambda k: F.get(r["values"], k))))
    sheet = Window.partitionBy("workbook", "sheet_idx")
    t = t.withColumn("boundary_signals", F.coalesce(F.sort_array(F.lead("first.signals").over(sheet.orderBy("part"))), F.array().cast("array<string>")))
    t = t.withColumn("rows", pruned).withColumn("row_count", F.size("rows"))
    if anchored is not None:
        t = t.join(anchored.groupBy("workbook", "sheet_idx").agg(F.max("row").alias("asset_end")), ["workbook", "sheet_idx"], "left").withColumn("end_row", F.greatest("end_row", F.coalesce("asset_end", F.lit(0)))).drop("asset_end")
    t = t.withColumn("table_no", F.row_number().over(sheet.orderBy("part"))).withColumn("table_of", F.count("*").over(sheet))
    t = t.withColumn("table_idx", F.row_number().over(Window.partitionBy("workbook").orderBy("sheet_idx", "part")))
    return t.drop("part", "first", "raw", "kept")


def cell_metadata(facts: DataFrame) -> DataFrame:
    """Cells that hold a value, formula, link or comment; a formula's value is its display value."""
    some = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("value", "formula", "hyperlink", "comment")]
    c = cells(facts).filter(some[0] | some[1] | some[2] | some[3])
    return c.select(*SHEET, "row", "col", "ref", "value", "value_num", "data_type", "number_format", "formula", F.when(F.col("formula").isNotNull(), F.col("value")).alias("display_value"), "hyperlink", "comment")


def in_tables(tables_: DataFrame, what: DataFrame, first: str, last: str) -> DataFrame:
    """Each table with the facts of its sheet whose rows first..last overlap its own: an equi-join on the sheet, and an overlap."""
    right = what.withColumnRenamed("workbook", "__w").withColumnRenamed("sheet_idx", "__s").drop("sheet", "state")
    near = (F.col("workbook") == F.col("__w")) & (F.col("sheet_idx") == F.col("__s")) & (F.col(first) <= F.col("end_row")) & (F.col(last) >= F.col("start_row"))
    return tables_.join(right, near).drop("__w", "__s")


def merged(facts: DataFrame) -> DataFrame:
    return facts.filter("fact = 'merge' and ref like '%:%'").select(*SHEET, F.col("ref").alias("merge_ref"), "first_row", "last_row")


def table_json(facts: DataFrame) -> DataFrame:
    """TABLE and the JSON text of each sub-table: rows, cells, merges, hidden rows and columns, assets in its rows."""
    t = tables(facts)
    key = [*TABLE]
    meta = in_tables(t, cell_metadata(facts).withColumn("r", F.col("row")), "row", "r")
    meta = meta.groupBy(*key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("ref"), F.struct("value", "data_type", "number_format", "formula", "display_value", "hyperlink", "comment"))))).alias("cells"))
    merges = in_tables(t, merged(facts), "first_row", "last_row").groupBy(*key).agg(F.sort_array(F.collect_list("merge_ref")).alias("merged_ranges"))
    hidden = in_tables(t, facts.filter("fact = 'hidden_row'").select(*SHEET, F.col("row").alias("hidden")).withColumn("h2", F.col("hidden")), "hidden", "h2").groupBy(*key).agg(F.sort_array(F.collect_set("hidden")).alias("hidden_rows"))
    columns = facts.filter("fact = 'hidden_col'").groupBy("workbook", "sheet_idx").agg(F.sort_array(F.collect_set("ref")).alias("hidden_columns"))
    own = in_tables(t, assets(facts).filter("asset_row is not null").select(*SHEET, "asset_row", F.col("asset_row").alias("a2"), "kind", "asset_ref", "cell", "filename", "title", "sha256"), "asset_row", "a2")
    own = own.groupBy(*key).agg(F.count_if(F.col("kind") == "chart").alias("chart_count"), F.count_if(F.col("kind") == "image").alias("image_count"), F.sort_array(F.collect_list(F.struct("kind", "asset_ref", "cell", "filename", "title", "sha256"))).alias("assets"))
    for part in (meta, merges, hidden, own):
        t = t.join(part, key, "left")
    t = t.join(columns, ["workbook", "sheet_idx"], "left")
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(f"array<{kind}>")).alias(c)
    body = F.struct("sheet", "state", "start_row", "end_row", "boundary_signals", "rows", "cells", none("merged_ranges", "string"), none("hidden_rows", "int"), none("hidden_columns", "string"), F.coalesce("chart_count", F.lit(0)).alias("chart_count"), F.coalesce("image_count", F.lit(0)).alias("image_count"), "assets")
    return t.select(*key, F.to_json(body).alias("json"))


def is_chinese(rows_: Column) -> Column:
    """Whether at least 0.3 of the characters of the non-blank text cells are CJK ideographs."""
    texts = F.filter(F.flatten(rows_), lambda v: v.isNotNull() & (T.strip(v) != "") & ~T.looks_numeric(v))
    all_ = F.length(F.array_join(texts, ""))
    return (all_ > 0) & (F.length(F.regexp_replace(F.array_join(texts, ""), "[^\u4e00-\u9fff]", "")) / F.greatest(all_, F.lit(1)) >= 0.3)


def _asset_lines(zh: Column) -> Column:
    """Markdown lines of one table's assets: images, charts, equations, then embedded objects."""
    say = lambda a, b: F.when(zh, F.lit(b)).otherwise(F.lit(a))

    def line(a: Column) -> Column:
        where = F.when(a["cell"].isNotNull(), F.concat(say(" at ", " 位于 "), F.lit("`"), a["cell"], F.lit("`"))).otherwise("")
        see = F.concat(F.lit(" ("), say("see ", "详见 "), F.lit("`assets/"))
        title = F.coalesce(F.nullif(a["title"], F.lit("")), say("(untitled)", "(无标题)"))
        return (
            F.when(a["kind"] == "image", F.concat(F.lit("!["), a["asset_ref"], F.lit("](assets/images/"), a["filename"], F.lit(")"), where))
            .when(a["kind"] == "chart", F.concat(F.lit("- Chart `"), a["asset_ref"], F.lit("`"), where, F.lit(": "), title, see, F.lit("charts/"), a["asset_ref"], F.lit(".json`)")))
            .when(a["kind"] == "equation", F.concat(F.lit("- "), say("Equation", "公式"), where, F.lit(": `"), a["text"], F.lit("`")))
            .otherwise(F.concat(F.lit("- "), say("Embedded", "嵌入对象"), F.lit(" `"), a["asset_ref"], F.lit("`"), where, see, F.lit("embedded/"), a["filename"], F.lit("`)")))
        )

    return F.transform("own", line)


def markdown(facts: DataFrame, source_name: Column) -> DataFrame:
    """workbook, content: every sub-table as a pipe table under a heading of its sheet."""
    t = tables(facts)
    rank = F.element_at(F.create_map(F.lit("image"), F.lit(1), F.lit("chart"), F.lit(2), F.lit("equation"), F.lit(3), F.lit("attachment"), F.lit(4)), F.col("kind"))
    own = in_tables(t, assets(facts).filter("asset_row is not null").select(*SHEET, "asset_row", F.col("asset_row").alias("a2"), "kind", "ref_no", "asset_ref", "cell", "filename", "title", "text"), "asset_row", "a2")
    own = own.groupBy(*TABLE).agg(F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "ref_no", "kind", "asset_ref", "cell", "filename", "title", "text"))).alias("own"))
    t = t.join(own, [*TABLE], "left").withColumn("own", F.coalesce("own", F.expr("filter(array(named_struct('rank', 0, 'ref_no', 0, 'kind', '', 'asset_ref', '', 'cell', '', 'filename', '', 'title', '', 'text', '')), x -> false)")))
    name = F.format_string("table_%03d", "table_idx")
    head = F.concat(F.lit("## Sheet: "), "sheet", F.when(F.col("table_of") > 1, F.format_string(" · Table %d/%d", "table_no", "table_of")).otherwise(""))
    extra = _asset_lines(is_chinese(F.col("rows")))
    block = F.concat(F.array(head, F.lit(""), F.concat(F.lit("- CSV: `tables/"), name, F.lit(".csv`")), F.concat(F.lit("- JSON: `tables/"), name, F.lit(".json`")), F.lit("")), T.markdown_table(F.col("rows")), F.when(F.size(extra) > 0, F.concat(F.array(F.lit("")), extra)).otherwise(F.array().cast("array<string>")), F.array(F.lit("")))
    body = t.select("workbook", "table_idx", F.array_join(block, "\n").alias("block")).groupBy("workbook").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("table_idx", "block"))), lambda x: x["block"]), "\n").alias("body"))
    books = facts.select("workbook").distinct().join(body, "workbook", "left")
    top = F.concat(F.lit("# Embedded Workbook "), "workbook", F.lit("\n\nSource file: `"), source_name, F.lit("`\n\n- Metadata: `workbook.json`\n\n"))
    return books.select("workbook", T.readable_col(F.concat(top, F.coalesce("body", F.lit("No non-empty sheets were found.\n")))).alias("content"))


def workbook_json(facts: DataFrame) -> DataFrame:
    """workbook and its metadata as JSON: sheets in order with their extent, merges, hidden rows and columns, and assets."""
    extent = cells(facts).groupBy("workbook", "sheet_idx").agg(F.max("row").alias("max_row"), F.max("col").alias("max_column"))
    collect = lambda fact, col, out: facts.filter(F.col("fact") == fact).groupBy("workbook", "sheet_idx").agg(F.sort_array(F.collect_set(col)).alias(out))
    s = facts.filter("fact = 'sheet'").select(*SHEET)
    for part in (extent, collect("merge", "ref", "merged_ranges"), collect("hidden_row", "row", "hidden_rows"), collect("hidden_col", "ref", "hidden_columns")):
        s = s.join(part, ["workbook", "sheet_idx"], "left")
    a = assets(facts).groupBy("workbook", "sheet_idx").agg(F.count_if(F.col("kind") == "chart").alias("chart_count"), F.count_if(F.col("kind") == "image").alias("image_count"))
    s = s.join(a, ["workbook", "sheet_idx"], "left")
    one = F.struct("sheet_idx", F.col("sheet").alias("name"), "state", F.coalesce("max_row", F.lit(1)).alias("max_row"), F.coalesce("max_column", F.lit(1)).alias("max_column"), "merged_ranges", "hidden_rows", "hidden_columns", F.coalesce("chart_count", F.lit(0)).alias("chart_count"), F.coalesce("image_count", F.lit(0)).alias("image_count"))
    return s.groupBy("workbook").agg(F.to_json(F.struct(F.count("*").alias("sheet_count"), F.sort_array(F.collect_list(one)).alias("sheets"))).alias("json"))


def warnings(facts: DataFrame) -> DataFrame:
    """workbook, warning: unreadable parts, and workbooks without any row."""
    read = facts.filter("warning is not null").select("workbook", "warning")
    empty = facts.select("workbook").distinct().join(rows(facts).filter(F.exists("values", lambda v: ~is_blank(v))), "workbook", "left_anti")
    return read.unionByName(empty.select("workbook", F.concat(F.lit("Workbook "), "workbook", F.lit(" did not contain non-empty sheets")).alias("warning")))
