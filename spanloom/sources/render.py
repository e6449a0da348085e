"""Texts with their chunks as HTML and as script data, for inspection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.schema import LabelSpace
from spanloom.sources.corpus_json import metadata

#: Colours of labels, by turns.
PALETTE = "crimson royalblue seagreen darkorange purple teal sienna deeppink olive slateblue".split()


def line_html(text: Column, chunks: Column, names: dict[int, str] | None = None) -> Column:
    """A span a chunk, with its range and label as title; text in no chunk is not shown."""
    palette = F.array(*map(F.lit, PALETTE))

    def span(c: Column) -> Column:
        name = c.label.cast("string")
        if names:
            name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), c.label), name)
        return F.concat(
            F.lit('<span title="st='), c.start.cast("string"), F.lit(",len="), c.len.cast("string"), F.lit(",lblId="),
            c.label.cast("string"), F.lit(",lbl="), name, F.lit('" style="border:solid 1px;color:'),
            F.element_at(palette, c.label % len(PALETTE) + 1), F.lit('">'), F.substr(text, c.start + 1, c.len), F.lit("</span>"),
        )

    return F.concat_ws("", F.transform(chunks, span))


def lines(texts: DataFrame, names: dict[int, str] | None = None) -> DataFrame:
    return texts.select("id", line_html(F.col("text"), F.col("chunks"), names).alias("html"))


def side_by_side(ref: DataFrame, res: DataFrame, names: dict[int, str] | None = None) -> DataFrame:
    """(id, ref_html, res_html): every reference text, with an empty cell where the other corpus lacks it."""
    left, right = lines(ref, names).withColumnRenamed("html", "ref_html"), lines(res, names).withColumnRenamed("html", "res_html")
    return left.join(right, "id", "left").select("id", "ref_html", F.coalesce("res_html", F.lit("")).alias("res_html"))


def page(rows: DataFrame, order: str = "id") -> str:
    """One HTML page of rendered rows; a page is for people, so its rows come to the driver."""
    cells = [c for c in rows.columns if c != order]
    body = "".join(
        f"<tr><th>{r[order]}</th>" + "".join(f"<td>{r[c]}</td>" for c in cells) + "</tr>" for r in rows.orderBy(order).toLocalIterator()
    )
    return f"<!DOCTYPE html><html><head></head><body><table><tbody>{body}</tbody></table></body></html>"


def script_rows(ref: DataFrame, res: DataFrame, space: LabelSpace) -> DataFrame:
    """(id, js): for each reference text, script that parses both texts' JSON, encoded twice."""
    pack = lambda df, name: metadata(df, space).select("id", F.struct("labelDefs", "labelGrps", "id", "text", "chunks").alias(name))
    both = pack(ref, "ref").join(pack(res, "res"), "id", "left")
    once = F.to_json(F.struct("ref", "res"))
    twice = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(once, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    return both.select("id", F.concat(F.lit("const pair = JSON.parse("), twice, F.lit(")")).alias("js"))
