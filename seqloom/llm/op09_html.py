"""HTML extraction by composite text density.

Every block element gets its characters per tag, adjusted by its links; the subtree whose children's
densities have the greatest sum is the article. The least density on the way from the body to it is
the threshold from which other subtrees are content too.

Names only cost: an element that is a menu, header, footer, sidebar, notice, advert or form by its tag
or by a whole class, id or role name has its densities lowered, reader comments more so. Where the
greatest sum is in such an element all the same, or it holds most of a page without an article
elsewhere, its name is forgiven; otherwise it is left out, as are those of them that have no article,
main, h1 or three paragraphs. An enclosing article is taken whole, a main but for its lists of links,
and headings above the content are its own. Scripts, styles and hidden elements never count.

A null or empty page has the empty text. A very long page takes time in proportion to its length, and
one page is in memory at a time beside its batch. Repeated rows are extracted each by itself; ties go to
the element that begins first; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from seqloom.llm.common import small_batches, text_of
from seqloom.llm.htmltext import extract


def main_text(pages: DataFrame, html_col: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The carried columns, text and n_chars (its code points); one pass without a shuffle."""
    small_batches(pages.sparkSession)
    source = pages.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), text_of(html_col).alias("html"))

    def work(batches):
        for batch in batches:
            texts = [extract(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    found = source.mapInArrow(work, StructType([source.schema["row"], StructField("text", StringType())]))
    return found.select("row.*", "text", F.length("text").cast("long").alias("n_chars"))
