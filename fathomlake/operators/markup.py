"""HTML to Markdown over a corpus, and the sections of filings."""

from __future__ import annotations

import re
from functools import partial
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.scalars import clean_text, normalize_section

#: Tags that are left out whole, and tags without an end.
NOISE = {"script", "style", "head", "title", "meta", "link"}
VOID = {"br", "meta", "link", "img", "hr", "input", "area", "base", "col", "embed", "source", "track", "wbr"}
#: Rows that are converted at a time.
SLICE = 64
#: The heading that begins each section of a form, in the order of the form.
SECTIONS = {
    "10-K": {
        "business": r"Item\s*1[\s\.]*Business",
        "risk_factors": r"Item\s*1A[\s\.]*Risk\s*Factors",
        "unresolved_staff_comments": r"Item\s*1B[\s\.]*Unresolved",
        "mda": r"Item\s*7[\s\.]*Management",
        "market_risk": r"Item\s*7A[\s\.]*Quantitative",
        "financial_statements": r"Item\s*8[\s\.]*Financial",
        "governance": r"Item\s*10[\s\.]*Directors",
        "signatures": r"Signatures",
    },
    "10-Q": {
        "mda": r"Item\s*2[\s\.]*Management",
        "market_risk": r"Item\s*3[\s\.]*Quantitative",
        "legal_proceedings": r"Part\s*II.*Item\s*1[\s\.]*Legal",
        "risk_factors": r"Item\s*1A[\s\.]*Risk\s*Factors",
    },
}


class _Markdown(HTMLParser):
    """Open tags as a stack of [tag, texts, rows or cells]; a tag's text goes to the one around it when it ends."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[list] = [["", [], []]]

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.open[-1][1].append("\n")
        elif tag not in VOID:
            self.open.append([tag, [], []])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if any(frame[0] == tag for frame in self.open[1:]):
            while self._end() != tag:
                pass

    def handle_data(self, data):
        self.open[-1][1].append(re.sub(r"[ \t]+", " ", data))

    def _around(self, *tags):
        return next((f for f in reversed(self.open) if f[0] in tags), None)

    def _end(self) -> str:
        tag, texts, parts = self.open.pop()
        text, bare, into = "".join(texts), "".join(texts).strip(), self.open[-1][1]
        if tag in ("strong", "b") and bare:
            into.append(f"**{bare}**")
        elif tag in ("em", "i") and bare:
            into.append(f"*{bare}*")
        elif tag in ("p", "div"):
            into.append(f"\n{text}\n")
        elif re.fullmatch("h[1-6]", tag):
            into.append(f"\n\n{'#' * int(tag[1])} {bare}\n\n")
        elif tag in ("td", "th"):
            if row := self._around("tr", "table"):
                row[2].append(bare.replace("\n", " ").replace("|", "\\|"))
        elif tag == "tr":
            if parts and (table := self._around("table")):
                table[2].append(parts)
        elif tag == "table":
            rows = [r for r in parts if isinstance(r, list)]
            width = max(map(len, rows), default=0)
            lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
            into.append("\n\n" + "\n".join([*lines[:1], *["| " + " | ".join(["---"] * width) + " |"] * bool(lines), *lines[1:]]) + "\n\n")
        elif tag not in NOISE and tag not in ("strong", "b", "em", "i", "thead", "tbody"):
            into.append(text)
        return tag

    def text(self) -> str:
        while len(self.open) > 1:
            self._end()
        lines = re.sub(r"\n{3,}", "\n\n", "".join(self.open[0][1])).split("\n")
        return "\n".join(line.rstrip() for line in lines).strip()


def to_markdown(html: str | None) -> str:
    parser = _Markdown()
    parser.feed(html or "")
    parser.close()
    return parser.text()


def _converted(batches, html: str, out: str):
    """The batches with one more column, in slices of a few rows, so that a task holds what it was given and few texts of its own."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            few = batch.slice(at, SLICE)
            made = pa.array([to_markdown(x.as_py()) for x in few.column(html)], pa.string())
            yield pa.RecordBatch.from_arrays([*few.columns, made], [*few.schema.names, out])


def html_to_markdown(df: DataFrame, html: str, out: str = "markdown") -> DataFrame:
    """``df`` and the Markdown of its column ``html`` (null: empty) as a new column ``out``: headings, emphasis, breaks, paragraphs and tables.

    Comments, scripts, styles and heads are left out; end tags without a beginning are ignored; tags that stay open end
    with the tag around them. Nesting can't be said with patterns, so Arrow batches of texts go through a parser.
    """
    return df.mapInArrow(partial(_converted, html=html, out=out), StructType([*df.schema.fields, StructField(out, StringType())]))


def sections(markdown: Column, form: str) -> Column:
    """A map of section to text. A section begins with the first line that its heading begins, shorter than 250 and no
    link of a table of contents, and ends where the next section of the form that was found begins."""
    lines = F.split(markdown, "\n")

    def begins(pattern: str) -> Column:
        hit = lambda x: x.rlike(rf"(?i)^#*\s*{pattern}") & (F.length(x) < 250) & ~x.rlike(r"\[.*\]\(#.*\)")
        return F.nullif(F.array_position(F.transform(lines, hit), F.lit(True)), F.lit(0).cast("long"))

    names = list(SECTIONS[form])
    starts = [begins(p) for p in SECTIONS[form].values()]
    after = F.size(lines) + 1
    spans = []
    for i, name in enumerate(names):
        end = F.coalesce(*starts[i + 1 :], after)
        text = clean_text(F.array_join(F.slice(lines, F.coalesce(starts[i], F.lit(1)).cast("int"), F.greatest(F.lit(0), (end - F.coalesce(starts[i], F.lit(1))).cast("int"))), "\n"))
        spans.append(F.when(starts[i].isNotNull(), F.struct(F.lit(name).alias("key"), text.alias("value"))))
    return F.map_from_entries(F.array_compact(F.array(*spans)))


def extract_sections(df: DataFrame, html: str, form: str) -> DataFrame:
    """``df`` and the map ``sections`` of its HTML column; no shuffle, as each row's lines stay with it."""
    return html_to_markdown(df, html, "_md").withColumn("sections", sections(F.col("_md"), form)).drop("_md")


def narrative_blocks(df: DataFrame, tag: str, text: str) -> DataFrame:
    """Rows with more than 20 characters of text, with ``section_name`` and the Markdown ``content_md``."""
    held = df.where(F.length(F.trim(text)) > 20).withColumn("section_name", normalize_section(F.col(tag)))
    return html_to_markdown(held, text, "content_md")
