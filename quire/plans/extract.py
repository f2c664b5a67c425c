"""From PDF bytes to page sizes, text, characters: one plan over the source's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import content, drawing, typeset
from ..sources import pdf


class Documents:
    """Lazy tables of a set of documents (doc_id, content); each is built once and shared by what follows."""

    def __init__(self, docs: DataFrame, password: bytes = b""):
        self.docs, self.password = docs, password
        self._made: dict[str, DataFrame] = {}

    def _table(self, name: str, make) -> DataFrame:
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    @property
    def xref(self) -> DataFrame:
        return self._table("xref", lambda: pdf.latest(pdf.xref(self.docs)))

    @property
    def nodes(self) -> DataFrame:
        """Parsed once: what is asked of the nodes several times is kept, on disk if memory is short, until ``close``."""
        return self._table("nodes", lambda: pdf.nodes(self.docs, self.password).persist())

    @property
    def tree(self) -> DataFrame:
        """The tables that the walk wrote are read once; a row a page is kept."""
        return self._table("tree", lambda: pdf.page_tree(self.nodes).persist())

    @property
    def pages(self) -> DataFrame:
        return self._table("pages", lambda: pdf.pages(self.nodes, tree=self.tree))

    @property
    def contents(self) -> DataFrame:
        return self._table("contents", lambda: pdf.contents(self.nodes, self.tree))

    @property
    def operations(self) -> DataFrame:
        return self._table("operations", lambda: content.operations(self.contents))

    @property
    def objects(self) -> DataFrame:
        return self._table("objects", lambda: content.page_objects(self.contents))

    @property
    def streams(self) -> DataFrame:
        return self._table("streams", lambda: pdf.streams(self.nodes))

    @property
    def drawn(self) -> DataFrame:
        """Page objects with those of the form XObjects that run."""
        return self._table("drawn", lambda: drawing.drawn(self.nodes, self.tree, self.streams, self.contents))

    @property
    def glyphs(self) -> DataFrame:
        """Characters set in their fonts, forms included."""
        return self._table("glyphs", lambda: typeset.glyphs(self.drawn, self.nodes, self.streams))

    @property
    def text(self) -> DataFrame:
        return content.page_text(self.objects)

    def close(self) -> None:
        """Releases what is kept; tables that are asked for again are made again."""
        for name in ("nodes", "tree"):
            if name in self._made:
                self._made[name].unpersist()
        self._made.clear()

    def __enter__(self) -> Documents:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def page_sizes_and_text(self) -> DataFrame:
        """doc_id, page_index, width, height, text of every page; pages without text have an empty one."""
        sizes = self.pages.select("doc_id", "page_index", "width", "height")
        return sizes.join(self.text, ["doc_id", "page_index"], "left").withColumn("text", F.coalesce("text", F.lit("")))
