"""Report pages: tables written as HTML in parts that Spark writes, and rows of such tables read back."""

from __future__ import annotations

import html
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurate.sources.writers import html_rows, shade

# The heading of the detail table and its labels.
DETAIL = "5. 逐条明细"
SOURCE_LABELS = {"gold_src": "金标源语", "hyp_asr": "模型转写"}
TARGET_LABELS = {"gold_zh": "金标中文", "hyp_mt": "模型译文"}
# Limits of a good and a bad error rate, in per cent.
GOOD_CER, BAD_CER = 10.0, 30.0


class _Row(HTMLParser):
    """Cells of one table row: their text, a line break for each ``br``, and what stands below each label."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.cells: list[list[str]] = []
        self.fields: list[list[tuple[str, list[str]]]] = []
        self.inside = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "td":
            self.cells.append([])
            self.fields.append([])
            self.inside = True
        elif tag == "br":
            self.handle_data("\n")
        elif tag == "div" and self.inside:
            self.fields[-1].append((dict(attrs).get("class") or "", []))

    def handle_endtag(self, tag: str) -> None:
        if tag == "td":
            self.inside = False
        elif tag == "div" and self.inside:
            self.fields[-1].append(("", []))

    def handle_data(self, data: str) -> None:
        if self.inside:
            self.cells[-1].append(data)
            if self.fields[-1]:
                self.fields[-1][-1][1].append(data)

    def texts(self) -> list[str]:
        return ["".join(c).strip() for c in self.cells]

    def labels(self) -> list[dict[str, str]]:
        """A label's text is the next block of text in its cell."""
        out: list[dict[str, str]] = []
        for fields in self.fields:
            found, label = {}, None
            for kind, parts in fields:
                said = "".join(parts).strip()
                if kind == "lab":
                    label = said
                elif kind == "txt" and label is not None:
                    found[label], label = said, None
            out.append(found)
        return out


def escaped(text: Column) -> Column:
    """A text as HTML; a null is empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    return out


def detail_lines(rows: DataFrame) -> Column:
    """A table row with all that ``scored_rows`` reads: lang_name, id, dur_desc, grade, comment, cer, wer, zh_cer, f1_asr, f1_zh and the four texts; figures that are null are left out."""
    lines = lambda *cs: F.concat_ws("<br>", *[escaped(F.col(c)) for c in cs])
    figure = lambda name, c: F.concat(F.lit(f"{name} "), F.format_string("%.4f", c), F.lit("%"))
    f1 = F.when(F.col("f1_asr").isNotNull() & F.col("f1_zh").isNotNull(), F.format_string("F1 %.4f/%.4f", "f1_asr", "f1_zh"))
    figures = [F.when(F.col(c).isNotNull(), figure(n, F.col(c))) for n, c in (("CER", "cer"), ("WER", "wer"), ("译中CER", "zh_cer"))]
    texts = lambda labels: F.concat(*[F.concat(F.lit(f'<div class="lab">{name}</div><div class="txt">'), escaped(F.col(c)), F.lit("</div>")) for c, name in labels.items()])
    cells = [lines("lang_name", "id", "dur_desc"), lines("grade", "comment"), F.concat_ws("<br>", *figures, f1), texts(SOURCE_LABELS), texts(TARGET_LABELS)]
    return F.concat(F.lit('<tr class="'), shade(F.col("cer"), GOOD_CER, BAD_CER), F.lit('"><td>'), F.concat_ws("</td><td>", *cells), F.lit("</td></tr>"))


def _cells(rows: pd.Series) -> pd.DataFrame:
    out = []
    for row in rows:
        r = _Row()
        r.feed(row)
        r.close()
        out.append((r.texts(), r.labels()))
    return pd.DataFrame(out, columns=["cells", "labels"])


def table_rows(pages: DataFrame, page: str, *keep: str, heading: str = DETAIL) -> DataFrame:
    """``keep``, nth (from 1), cls, cells (array of texts) and labels (a map for each cell) of the table rows after a heading, but for the first, the table's head.

    A page without the heading or without rows gives nothing; so does a null.  A
    page is one row; its table rows are exploded before any Python sees them.
    """
    at = F.instr(F.col(page), F.lit(heading))
    section = F.when(at > 0, F.substring(F.col(page), at, F.length(page)))
    rows = F.regexp_extract_all(section, F.lit(r"(?s)(<tr[^>]*>.*?</tr>)"), F.lit(1))
    each = pages.select(*keep, F.posexplode(rows).alias("nth", "row")).where("nth > 0")
    cls = F.regexp_extract("row", r'^<tr[^>]*?class="([^"]*)"', 1)
    return each.select(*keep, "nth", cls.alias("cls"), F.pandas_udf(_cells, "struct<cells:array<string>,labels:array<map<string,string>>>")("row").alias("c")).select(*keep, "nth", "cls", "c.*")


def scored_rows(rows: DataFrame, *keep: str) -> DataFrame:
    """Typed rows of a detail table: names, verdict, figures (null if not there) and texts (empty if not there)."""
    cell = lambda n: F.coalesce(F.get("cells", n), F.lit(""))
    lines = lambda n: F.filter(F.split(cell(n), "\n"), lambda x: x != "")
    line = lambda n, k: F.get(lines(n), k)
    figure = lambda p, g=1: F.nullif(F.regexp_extract(cell(2), p, g), F.lit("")).try_cast("double")
    text = lambda n, label: F.coalesce(F.try_element_at(F.get("labels", n), F.lit(label)), F.lit(""))
    verdict = lines(1)
    return rows.select(
        *keep,
        "nth",
        line(0, 0).alias("lang_name"),
        line(0, 1).alias("id"),
        F.coalesce(line(0, 2), F.lit("")).alias("dur_desc"),
        F.coalesce(line(1, 0), F.lit("")).alias("grade"),
        F.array_join(F.slice(verdict, 2, F.greatest(F.size(verdict), F.lit(1))), " ").alias("comment"),
        "cls",
        figure(r"CER ([\d.]+)%").alias("cer"),
        figure(r"WER ([\d.]+)%").alias("wer"),
        figure(r"译中CER ([\d.]+)%").alias("zh_cer"),
        figure(r"F1 ([\d.]+)/([\d.]+)").alias("f1_asr"),
        figure(r"F1 ([\d.]+)/([\d.]+)", 2).alias("f1_zh"),
        *[text(3, name).alias(c) for c, name in SOURCE_LABELS.items()],
        *[text(4, name).alias(c) for c, name in TARGET_LABELS.items()],
    )


def table_section(df: DataFrame, heading: str, order: list[Column | str], shaded: dict[str, tuple[float, float]] | None = None) -> tuple[str, DataFrame]:
    """A heading and the lines of a table in order, with the columns' names as its head."""
    head = "<tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in df.columns) + "</tr>"
    return f"<h2>{html.escape(heading)}</h2>\n<table>\n{head}", html_rows(df.orderBy(*order), shaded)


def write_page(spark: SparkSession, path: str, title: str, sections: list[tuple[str, DataFrame]]) -> None:
    """A page as numbered folders of text: its head, then each section's heading and sorted lines, then its end.

    Files in the order of their names are the page, so rows never pass through
    the driver; ``page_files`` lists them in order.
    """
    text = lambda lines: spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)
    text([f'<!doctype html>\n<html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body>\n<h1>{html.escape(title)}</h1>']).write.mode("overwrite").text(f"{path}/0000-head")
    for k, (head, lines) in enumerate(sections, 1):
        text([head]).write.mode("overwrite").text(f"{path}/{k:04d}-a-head")
        lines.write.mode("overwrite").text(f"{path}/{k:04d}-b-rows")
        text(["</table>"]).write.mode("overwrite").text(f"{path}/{k:04d}-c-end")
    text(["</body></html>"]).write.mode("overwrite").text(f"{path}/9999-end")


def page_files(spark: SparkSession, path: str) -> list[str]:
    """The files of a written page in their order, for whoever serves or joins them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*.txt").load(path).select("path")
    return [r["path"] for r in files.orderBy("path").collect()]  # names of files, not rows
