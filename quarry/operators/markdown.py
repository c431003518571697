"""Markdown chunker in built-in functions: one fold over the lines of a file, no shuffle, no Python.

Headings are ``#`` lines and underlined lines outside fenced code. A section runs to the line before
the next heading (the last one to the end of the file); text before the first heading is a ``module``
chunk named by the file's stem; a YAML block at the top belongs to nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import lines, newlines, not_blank

_HEADING = "array<struct<line:int,body:int,name:string>>"
_ATX = r"^ {0,3}#{1,6}(?:[ \t]|$)"
_UNDERLINE = r"^ {0,3}(?:=+|-+)[ \t]*$"
_FENCE = r"^ {0,3}(`{3,}|~{3,})"
#: A line that cannot be the text of an underlined heading.
_NO_TEXT = r"^\s*$|^ {0,3}(?:#{1,6}(?:[ \t]|$)|>|[-*+] |\d+[.)] |`{3,}|~{3,})"


def heading_text(line: Column) -> Column:
    """Text of a ``#`` heading without its marks."""
    return F.trim(F.regexp_replace(F.regexp_replace(line, r"^\s*#{1,6}[ \t]*", ""), r"(?:^|[ \t]+)#+[ \t]*$", ""))


def is_heading(line: Column) -> Column:
    return line.rlike(_ATX)


def frontmatter_end(all_lines: Column) -> Column:
    """Last line of the YAML block at the top; 0 without one."""
    close = F.array_position(F.transform(F.slice(all_lines, 2, 1 << 30), lambda x: x.rlike(r"^(?:---|\.\.\.)\s*$").cast("string")), "true")
    return F.when(F.element_at(all_lines, 1).rlike(r"^---\s*$") & (close > 0), (close + 1).cast("int")).otherwise(0)


def _headings(all_lines: Column, skip: Column) -> Column:
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("fence"), F.lit("").alias("last"), F.array().cast(_HEADING).alias("found"))

    def step(acc: Column, line: Column) -> Column:
        n = acc["n"] + 1
        mark = F.regexp_extract(line, _FENCE, 1)
        within = acc["fence"] != ""
        closes = within & (mark != "") & line.rlike(r"^\s*[`~]+\s*$") & F.startswith(mark, acc["fence"])
        fence = F.when(n <= skip, "").when(closes, "").when(~within & (mark != ""), mark).otherwise(acc["fence"])
        open_text = ~within & (n > skip)
        atx = open_text & line.rlike(_ATX)
        under = open_text & line.rlike(_UNDERLINE) & ~acc["last"].rlike(_NO_TEXT)
        head = F.when(atx, F.struct(n.alias("line"), (n + 1).alias("body"), heading_text(line).alias("name"))).when(under, F.struct((n - 1).alias("line"), (n + 1).alias("body"), F.trim(acc["last"]).alias("name")))
        last = F.when((n <= skip) | within | atx | under, "").otherwise(line)
        return F.struct(n.alias("n"), fence.alias("fence"), last.alias("last"), F.when(atx | under, F.concat(acc["found"], F.array(head))).otherwise(acc["found"]).alias("found"))

    return F.aggregate(all_lines, start, step, lambda acc: acc["found"])


def chunk_markdown(files: DataFrame) -> DataFrame:
    """(file_path, content) to chunks (file_path, line_start, line_end, content, chunk_type, name)."""
    read = files.select("file_path", newlines(F.col("content")).alias("content")).where(not_blank(F.col("content")))
    split = read.select("file_path", lines(F.col("content")).alias("l"))
    skip = split.withColumn("skip", frontmatter_end(F.col("l")))
    heads = skip.withColumn("h", _headings(F.col("l"), F.col("skip"))).withColumn("size", F.size("l"))
    stem = F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    before = F.struct((F.col("skip") + 1).alias("line"), F.lit("module").alias("kind"), stem.alias("name"))
    sections = F.transform("h", lambda x: F.struct(x["line"].alias("line"), F.lit("section").alias("kind"), x["name"].alias("name")))
    each = heads.select("file_path", "l", "size", F.explode(F.sequence(F.lit(0), F.size("h"))).alias("i"), F.concat(F.array(before), sections).alias("s"))
    this = F.element_at("s", F.col("i") + 1)
    end = F.when(F.col("i") + 1 < F.size("s"), F.try_element_at("s", F.col("i") + 2)["line"] - 1).otherwise(F.col("size"))
    cut = each.select("file_path", "l", this.alias("c"), end.alias("line_end"))
    cut = cut.where(F.col("line_end") >= F.col("c.line")).withColumn("own", F.slice("l", F.col("c.line"), F.col("line_end") - F.col("c.line") + 1))
    # a module chunk begins at its first line with text
    blank = F.when(F.col("c.kind") == "module", F.greatest(F.array_position(F.transform("own", lambda x: x.rlike(r"\S").cast("string")), "true") - 1, F.lit(0))).otherwise(0).cast("int")
    led = cut.withColumn("blank", blank).withColumn("own", F.slice("own", F.col("blank") + 1, F.greatest(F.size("own"), F.lit(1))))
    out = led.select("file_path", (F.col("c.line") + F.col("blank")).cast("int").alias("line_start"), F.col("line_end").cast("int").alias("line_end"), F.regexp_replace(F.array_join("own", "\n"), r"\n+$", "").alias("content"), F.col("c.kind").alias("chunk_type"), F.col("c.name").alias("name"))
    return out.where(not_blank(F.col("content")))
