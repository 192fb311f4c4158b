"""Markdown from the node array through an Arrow UDF.

The node array is already parsed, so the Python step only walks a tree; the
column is narrowed (stripped subtrees removed, unused fields dropped) before
it crosses to Python."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webtables.functions import structure
from webtables.functions.markdown import nodes_markdown, without_subtrees
from webtables.operators.selectors import selection

# pages turned into Python objects at a time
PAGES = 64


def _slim(nodes: Column) -> Column:
    fields = ("id", "parent", "end_id", "prev_sib", "kind", "tag", "attrs", "text")
    return F.transform(nodes, lambda n: F.struct(*[n[f].alias(f) for f in fields]))


def nodes_to_markdown(nodes: Column, strip_tags: list[str] | None = None) -> Column:
    """H2: html_to_markdown of a page or of parts of one; strips only when ``strip_tags``
    is non-empty."""

    @F.arrow_udf(T.StringType())
    def write(nodes: pa.Array) -> pa.Array:
        out: list[str | None] = []
        for i in range(0, len(nodes), PAGES):
            out.extend(v if v is None else nodes_markdown(without_subtrees(v, strip_tags)) for v in nodes.slice(i, PAGES).to_pylist())
        return pa.array(out, type=pa.string())

    return write(_slim(nodes))


def selected_markdown(nodes: Column, selector: str, strip_tags: list[str] | None = None) -> Column:
    """H2 after a selector: the markdown of the matched subtrees, one after the other. The
    matching is done in the writer's step, so the nodes cross to Python once."""
    flags, program = selection(nodes, selector)

    @F.arrow_udf(T.StringType())
    def write(nodes: pa.Array, flags: pa.Array) -> pa.Array:
        out: list[str | None] = []
        for i in range(0, len(nodes), PAGES):
            f, _ = structure.flat(flags.slice(i, PAGES))
            at = 0
            for page in nodes.slice(i, PAGES).to_pylist():
                if page is None:
                    out.append(None)
                    continue
                n = len(page)
                parent, end, prev = (np.array([-1 if v[c] is None else v[c] for v in page], np.int64) for c in ("parent", "end_id", "prev_sib"))
                hit = structure.selected(f[at : at + n], parent, end, prev, np.array([0, n]), program)
                at += n
                parts = [v for k in np.flatnonzero(hit).tolist() for v in page[k : page[k]["end_id"] + 1]]
                out.append(nodes_markdown(without_subtrees(parts, strip_tags)))
        return pa.array(out, type=pa.string())

    return write(_slim(nodes), flags)
