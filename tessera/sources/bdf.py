"""Bulk data files (GRID, element and SPC cards) as tables.

Cards depend on the order of lines, so lines become rows with their number: files are read in blocks,
and a line's number is its place in its block after all lines of the blocks before.
A model is one file, or the ordered pieces of one; any other folder of several is
refused, as their lines would run into each other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.arrays import nastran_real
from tessera.functions.prefix import dense_index
from tessera.session import cut

# Element keywords in the order they are tried (the first that a card starts with), least and most nodes.
ELEMENTS = [
    ("CBAR", 2, 2), ("CQUADR", 4, 4), ("CQUAD4", 4, 4), ("CQUAD8", 8, 8), ("CQUAD9", 9, 9), ("CQUAD", 9, 9),
    ("CHEXA27", 27, 27), ("CHEXA", 8, 8), ("CTRIA3", 3, 3), ("CTETRA", 4, 10),
]
# Place in the file's order of each local node; identity for the others.
NODE_ORDER = {
    "CQUAD4": [0, 1, 3, 2], "CQUADR": [0, 1, 3, 2], "CQUAD9": [0, 4, 1, 7, 8, 5, 3, 6, 2], "CQUAD": [0, 4, 1, 7, 8, 5, 3, 6, 2],
    "CHEXA": [0, 1, 3, 2, 4, 5, 7, 6],
}
LINE = 81
#: Lines that are numbered together.
CHUNK = 50_000


@dataclass
class BulkData:
    nodes: DataFrame  # node, x, y, z
    elems: DataFrame  # elem, comp, etype
    elem_nodes: DataFrame  # elem, lnode, node
    spc: DataFrame  # node, dof, val (dof from 0)
    components: DataFrame  # comp, name, etype
    warnings: DataFrame  # line_no, keyword

    def bcs(self, dofs_per_node: int = 6) -> DataFrame:
        """(dof): constrained global dofs; prescribed values stay in `spc`."""
        return self.spc.select((F.col("node") * dofs_per_node + F.col("dof")).alias("dof")).distinct()


class BulkDataError(ValueError):
    pass


def lines(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """(line_no, line): at most 81 characters of each line of one file, numbered from 0; raises if the path holds several.

    parts: the path is a folder of ordered pieces of one file, as `sinks.write_lines` leaves
    them, which follow each other by name. Files are read in Spark's blocks; a line's
    number is its place in its block after the lines of all blocks before, so no task sees more than a block.
    """
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"), F.substring("value", 1, LINE).alias("line"))
    text = cut(text)  # ids are those of one reading
    blocks = text.groupBy("file", "at").agg(F.count("*").alias("n"))
    if not parts and (n := len(spark.read.text(path).inputFiles())) > 1:
        raise BulkDataError(f"{path} holds {n} files; read them one by one")
    order = Window.orderBy("file", "at").rowsBetween(Window.unboundedPreceding, 0)  # a row for each block
    blocks = blocks.select(F.col("file").alias("_f"), F.col("at").alias("_a"), (F.sum("n").over(order) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("file", "at").orderBy("id")) - 1
    numbered = text.withColumn("_in", inside).join(F.broadcast(blocks), (F.col("file") == F.col("_f")) & (F.col("at") == F.col("_a")))
    return numbered.select((F.col("before") + F.col("_in")).alias("line_no"), "line")


def bulk(all_lines: DataFrame) -> DataFrame:
    """Lines after the last BEGIN BULK (all, if there is none) and before the end of the bulk."""
    start = all_lines.filter(F.col("line").startswith("BEGIN BULK")).agg(F.coalesce(F.max("line_no"), F.lit(-1))).first()[0]
    rest = all_lines.filter(F.col("line_no") > start)
    is_end = F.col("line").startswith("END BULK") | F.col("line").startswith("ENDDATA")
    end = rest.filter(is_end).agg(F.min("line_no")).first()[0]
    return rest if end is None else rest.filter(F.col("line_no") < end)


def field(line: Column, start: int, width: int) -> Column:
    return F.trim(F.substring(line, start + 1, width))


def cards(body: DataFrame) -> DataFrame:
    """(line_no, head, more): a card's first line and its continuations, in order; comments are left out.

    A continuation starts with `*` or a space. A card has a few lines, so its list is bounded.
    """
    rows = body.filter(~F.col("line").startswith("$")).withColumn("chunk", F.floor(F.col("line_no") / CHUNK))
    head = ~(F.col("line").startswith("*") | F.col("line").startswith(" "))
    # cards before each chunk of lines, so that continuations at its beginning go on with the last of them
    starts = rows.groupBy(F.col("chunk").alias("_c")).agg(F.sum(head.cast("int")).alias("n"))
    starts = starts.withColumn("before", F.sum("n").over(Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    inside = Window.partitionBy("chunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("_in", F.sum(head.cast("int")).over(inside)).join(F.broadcast(starts), F.col("chunk") == F.col("_c"))  # a row for each chunk
    numbered = numbered.select("line_no", "line", (F.col("before") + F.col("_in")).alias("card"))
    packed = numbered.groupBy("card").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    packed = packed.filter("card > 0")
    return packed.select(F.col("ls")[0]["line_no"].alias("line_no"), F.col("ls")[0]["line"].alias("head"), F.transform(F.slice("ls", 2, F.size("ls")), lambda x: x["line"]).alias("more"))


def _node_cards(all_cards: DataFrame) -> DataFrame:
    head, next_line = F.col("head"), F.coalesce(F.try_element_at("more", F.lit(1)), F.lit(""))
    grid = all_cards.filter(head.startswith("GRID"))
    long, comma = head.startswith("GRID*"), F.contains(F.substring(head, 1, 80), F.lit(","))
    parts = F.split(head, ",")
    part = lambda i: F.trim(F.coalesce(F.try_element_at(parts, F.lit(i + 1)), F.lit("")))
    pick = lambda where, at_long, at_short, at_comma: F.when(long, field(next_line if where else head, at_long, 16)).when(comma, part(at_comma)).otherwise(field(head, at_short, 8))
    return grid.select(
        "line_no",
        pick(False, 8, 8, 1).try_cast("long").alias("file_id"),
        nastran_real(pick(False, 40, 24, 3)).alias("x"),
        nastran_real(pick(False, 56, 32, 4)).alias("y"),
        nastran_real(pick(True, 8, 40, 5)).alias("z"),
    )


def _element_cards(all_cards: DataFrame) -> DataFrame:
    head = F.col("head")
    etype = F.lit(None).cast("string")
    for name, _, _ in reversed(ELEMENTS):
        etype = F.when(head.startswith(name), name).otherwise(etype)
    rows = all_cards.withColumn("etype", etype).filter(F.col("etype").isNotNull())
    # a star after the keyword: fields of 16
    wide = F.contains(F.substring("head", 1, 8), F.lit("*"))
    cut8 = lambda line: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.trim(F.substring(line, i * 8 + 9, F.lit(8))))
    cut16 = lambda line: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.trim(F.substring(line, i * 16 + 9, F.lit(16))))
    every = F.flatten(F.transform(F.concat(F.array("head"), F.col("more")), lambda x: F.when(wide, cut16(x)).otherwise(cut8(x))))
    rows = rows.withColumn("fields", every)
    numbers = F.transform(F.filter(F.slice("fields", 3, 10_000), lambda x: x != ""), lambda x: x.try_cast("long"))
    rows = rows.select("line_no", "etype", F.col("fields")[0].try_cast("long").alias("file_id"), F.col("fields")[1].try_cast("long").alias("comp"), numbers.alias("ns"))
    # a node that is no positive number ends the list
    stop = F.array_position(F.transform("ns", lambda x: F.coalesce(x <= 0, F.lit(True))), True)
    most = F.lit(0)
    for name, _, high in ELEMENTS:
        most = F.when(F.col("etype") == name, high).otherwise(most)
    return rows.withColumn("ns", F.when(stop > 0, F.slice("ns", F.lit(1), (stop - 1).cast("int"))).otherwise(F.col("ns"))).withColumn("ns", F.slice("ns", F.lit(1), most))


def _spc_cards(all_cards: DataFrame) -> DataFrame:
    head = F.col("head")
    wide = head.startswith("SPC*")
    rows = all_cards.filter(wide | head.rlike(r"^SPC\s"))
    pick = lambda a, b: F.when(wide, field(head, a, 16)).otherwise(field(head, b, 8))
    rows = rows.select("line_no", pick(24, 16).try_cast("long").alias("file_node"), pick(40, 24).alias("dofs"), nastran_real(pick(56, 32)).alias("val"))
    digits = rows.select("file_node", "val", F.explode(F.split("dofs", "")).alias("d"))
    return digits.filter(F.col("d").rlike("^[1-8]$")).select("file_node", (F.col("d").cast("int") - 1).alias("dof"), "val")


def read(spark: SparkSession, path: str, parts: bool = False) -> BulkData:
    """Tables of a bulk data file; ids are ranks of the ids in the file, from 0.

    Raises on an empty line in the bulk, ids that are not positive, too few nodes,
    and nodes that no GRID card has. Unknown keywords are listed in `warnings`.
    Element ids that repeat are elements of their own, in the order of the file.
    """
    body = cut(bulk(lines(spark, path, parts)))
    if blank := body.filter(F.col("line") == "").agg(F.min("line_no")).first()[0]:
        raise BulkDataError(f"line {blank + 1} is empty")
    parsed = cut(cards(body))
    raw_nodes, raw_elems, raw_spc = cut(_node_cards(parsed)), cut(_element_cards(parsed)), cut(_spc_cards(parsed))
    least = F.lit(0)
    for name, low, _ in ELEMENTS:
        least = F.when(F.col("etype") == name, low).otherwise(least)
    for rows, bad, what in (
        (raw_nodes, F.col("file_id").isNull() | (F.col("file_id") <= 0), "a node id is not positive"),
        (raw_elems, F.coalesce((F.col("file_id") <= 0) | (F.col("comp") <= 0), F.lit(True)), "an element or component id is not positive"),
        (raw_elems, F.size("ns") < least, "an element has too few nodes"),
    ):
        if at := rows.filter(bad).select("line_no").first():
            raise BulkDataError(f"line {at[0] + 1}: {what}")
    nodes = dense_index(raw_nodes, "file_id", "node")
    ids = nodes.select("file_id", "node").distinct()
    # ties of repeated element ids go by line
    last = raw_elems.agg(F.max("line_no")).first()[0] or 0
    order = dense_index(raw_elems, "file_id", "_rank").withColumn("_order", F.col("_rank") * (last + 1) + F.col("line_no"))
    numbered = cut(dense_index(order, "_order", "elem").drop("_rank"))
    spots = F.lit(None).cast("array<int>")
    for name, spot in NODE_ORDER.items():
        spots = F.when(F.col("etype") == name, F.array(*map(F.lit, spot))).otherwise(spots)
    ordered = numbered.withColumn("_spots", spots)
    placed = F.when(F.col("_spots").isNotNull(), F.transform("_spots", lambda i: F.col("ns")[i])).otherwise(F.col("ns"))
    conn = ordered.select("elem", "line_no", F.posexplode(placed).alias("lnode", "file_id")).join(ids, "file_id", "left")
    held = raw_spc.join(ids, F.col("file_node") == F.col("file_id"), "left")
    for rows in (conn, held):
        if at := rows.filter("node is null").first():
            raise BulkDataError(f"node {at['file_id'] if 'lnode' in rows.columns else at['file_node']} has no GRID card")
    known = "|".join(["GRID", "SPC", *(e[0] for e in ELEMENTS)])
    odd = parsed.filter(~F.col("head").rlike(f"^({known})") & (F.trim("head") != "")).select("line_no", F.regexp_extract("head", r"^\S{1,8}", 0).alias("keyword"))
    elems = numbered.select("elem", (F.col("comp") - 1).cast("int").alias("comp"), F.when((F.col("etype") == "CTETRA") & (F.size("ns") == 10), "CTETRA10").otherwise(F.col("etype")).alias("etype"))
    return BulkData(nodes.select("node", "x", "y", "z"), elems, conn.select("elem", "lnode", "node"), held.select("node", "dof", "val"), _components(body, elems), odd)


def _components(body: DataFrame, elems: DataFrame) -> DataFrame:
    """(comp, name, etype): the k-th `$       Shell` comment names component k; its first element gives the type."""
    named = body.filter(F.col("line").rlike(r"^\$       Shell"))
    named = named.select((F.row_number().over(Window.orderBy("line_no")) - 1).alias("comp"), F.regexp_extract(F.substring("line", 42, 32), r"^\s*(\S+)", 1).alias("name"))
    return named.join(elems.groupBy("comp").agg(F.min_by("etype", "elem").alias("etype")), "comp", "full")
