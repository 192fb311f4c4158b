"""Parse pages once into a ``nodes`` array; node-array helpers.

``parse_pages`` is a ``mapInArrow`` (a relation boundary), so Catalyst never
duplicates the parse when a later filter reads node fields, and the Python
worker sees Arrow batches, not pickled rows. Select only the columns you need
before calling it: Catalyst cannot prune columns through the Python stage.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webtables.functions import structure
from webtables.functions.html import parse_html, tag_masks
from webtables.functions.text import let
from webtables.session import spread as deal
from webtables.schema import NODES

_ARROW_NODE_FIELDS = [
    ("id", pa.int32()),
    ("parent", pa.int32()),
    ("end_id", pa.int32()),
    ("depth", pa.int32()),
    ("sib", pa.int32()),
    ("type_sib", pa.int32()),
    ("n_sib", pa.int32()),
    ("n_type", pa.int32()),
    ("prev_sib", pa.int32()),
    ("kids", pa.int32()),
    ("kind", pa.string()),
    ("tag", pa.string()),
    ("attrs", pa.map_(pa.string(), pa.string())),
    ("text", pa.string()),
    ("up0", pa.int64()),
    ("up1", pa.int64()),
    ("start", pa.int32()),
    ("stop", pa.int32()),
]


def _nodes_array(pages: list[list[list] | None]) -> pa.Array:
    """Columnar build of list<struct> from per-page node rows (one C-level
    transpose of all rows, then one Arrow conversion per field)."""
    offsets = [0]
    valid = []
    flat: list[list] = []
    for rows in pages:
        if rows is None:
            valid.append(False)
        else:
            valid.append(True)
            flat.extend(rows)
        offsets.append(len(flat))
    cols = list(zip(*flat)) if flat else [() for _ in _ARROW_NODE_FIELDS]
    children = []
    for (name, typ), vals in zip(_ARROW_NODE_FIELDS, cols):
        if name == "attrs":
            vals = [None if v is None else list(v.items()) for v in vals]
        children.append(pa.array(vals, type=typ))
    struct = pa.StructArray.from_arrays(children, names=[n for n, _ in _ARROW_NODE_FIELDS])
    mask = pa.array([not v for v in valid], type=pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), struct, mask=mask)


def _markdown_of(rows: list[list], strip_tags: list[str]) -> str:
    from webtables.functions.html import NODE_FIELDS
    from webtables.functions.markdown import nodes_markdown, without_subtrees

    return nodes_markdown(without_subtrees([dict(zip(NODE_FIELDS, r)) for r in rows], strip_tags))


# pages parsed per output batch: bounds the Python worker's memory even
# when an input Arrow batch holds thousands of large pages
SLICE_PAGES = 64


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE_PAGES):
            yield batch.slice(i, SLICE_PAGES)


def _parse_batches(html_col: str, keep_html: bool, markdown_strip: list[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            idx = batch.schema.get_field_index(html_col)
            htmls = batch.column(idx).to_pylist()
            pages, errors, mds = [], [], []
            for h in htmls:
                if h is None:
                    pages.append(None)
                    errors.append("ValueError: page has no content")
                    mds.append(None)
                    continue
                rows = md = error = None
                try:
                    rows = parse_html(h)
                    if markdown_strip is not None:
                        md = _markdown_of(rows, markdown_strip)
                except Exception as e:  # P6: one bad page never fails the job
                    rows, md, error = None, None, f"{type(e).__name__}: {e}"
                pages.append(rows)
                errors.append(error)
                mds.append(md)
            keep = [i for i in range(batch.num_columns) if keep_html or i != idx]
            cols = [batch.column(i) for i in keep] + [_nodes_array(pages), pa.array(errors, type=pa.string())]
            names = [batch.schema.names[i] for i in keep] + ["nodes", "parse_error"]
            if markdown_strip is not None:
                cols.append(pa.array(mds, type=pa.string()))
                names.append("markdown")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def parse_pages(df: DataFrame, html_col: str = "html", spread: int | None = None, keep_html: bool = True,
                markdown_strip: list[str] | None = None) -> DataFrame:
    """Append ``nodes array<NODE>`` and ``parse_error string`` to every row.

    ``keep_html=False`` drops the raw HTML inside the Python step, so it is
    not shipped back (only selector output needs it after the parse).
    ``markdown_strip`` (a list, possibly empty) also writes a ``markdown``
    column in the same pass (H2 without a selector), which saves sending
    the node array to Python a second time.

    Parsing is CPU work per page. ``spread`` (or ``spark.webtables.spread``)
    deals the rows of a few large files over that many tasks first; without
    it a crawl is parsed where it is read, without a shuffle."""
    df = deal(df, spread)
    fields = [f for f in df.schema.fields if keep_html or f.name != html_col]
    fields += [T.StructField("nodes", NODES), T.StructField("parse_error", T.StringType())]
    if markdown_strip is not None:
        fields.append(T.StructField("markdown", T.StringType()))
    return df.mapInArrow(_parse_batches(html_col, keep_html, markdown_strip), T.StructType(fields))


def explode_nodes(parsed: DataFrame, keys=("page_id",)) -> DataFrame:
    """The ``nodes`` table: one row per node (keys + node fields)."""
    return parsed.select(*keys, F.inline("nodes"))


# ---------------------------------------------------------------------------
# Node-array column helpers. ``nodes`` must be the complete parse (id ==
# position) for the slice-based helpers; filtered arrays are only consumed by
# helpers that do not index.
# ---------------------------------------------------------------------------


def node_at(nodes: Column, node_id: Column) -> Column:
    """Node with the given id (0-based) from a complete node array."""
    return F.get(nodes, node_id)


def subtree(nodes: Column, n: Column) -> Column:
    """Descendants of node ``n`` (contiguous in pre-order)."""
    return F.slice(nodes, n["id"] + 2, n["end_id"] - n["id"])


def has_ancestor(n: Column, tags: list[str]) -> Column | None:
    """Whether one of ``n``'s ancestors has one of ``tags``, from its set of ancestors'
    tags; None if the set does not hold one of them (custom elements)."""
    masks = tag_masks(tags)
    if masks is None:
        return None
    return (n["up0"].bitwiseAND(masks[0]) != 0) | (n["up1"].bitwiseAND(masks[1]) != 0)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _nearest_udf(parents: pa.Array, marks: pa.Array) -> pa.Array:
    return structure.nearest_lists(parents, marks)


def nearest_above(nodes: Column, mark) -> Column:
    """For each node of a whole page the id of the nearest node above it that ``mark``
    selects, -1 without one: a structural join of the page with itself, at any depth."""
    return _nearest_udf(F.transform(nodes, lambda n: n["parent"]), F.transform(nodes, lambda n: F.coalesce(mark(n), F.lit(False))))


def has_tag(n: Column, tags: list[str]) -> Column:
    return F.coalesce(n["tag"].isin(*tags), F.lit(False))


def strip_subtrees(nodes: Column, tags: list[str] | None) -> Column:
    """Drop the named elements and everything inside them, from a whole page. Known
    tags are looked up in each node's set of ancestors' tags; custom ones take the
    structural join."""
    if not tags:
        return nodes
    tags = [t.lower() for t in tags]
    if tag_masks(tags) is not None:
        return F.filter(nodes, lambda n: ~(has_tag(n, tags) | has_ancestor(n, tags)))
    above = nearest_above(nodes, lambda n: has_tag(n, tags))
    return let(above, lambda near: F.filter(nodes, lambda n, i: ~has_tag(n, tags) & (F.get(near, i) < 0)))


def parse_with_store(pages: DataFrame, store_path: str, html_col: str = "html") -> DataFrame:
    """Result reuse: parse only pages whose content is not yet in the node
    store (parquet of ``content_hash, nodes, parse_error`` under a shared
    folder), append the new parses, and return the pages with their nodes.
    Pages without content stay, with null nodes and the parser's error.

    Identical pages (same hash) are parsed once; a re-crawl that changed
    few pages parses only those. The store is append-only, so a lost
    executor can at worst leave a duplicate hash, which ``dropDuplicates``
    on read removes."""
    spark = pages.sparkSession
    # a page without content has a key of its own, which no digest equals
    hashed = pages.withColumn("content_hash", F.coalesce(F.sha2(F.col(html_col), 256), F.lit("")))
    folder = spark._jvm.org.apache.hadoop.fs.Path(store_path)
    todo = hashed
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        known = spark.read.parquet(store_path).select("content_hash")
        todo = hashed.join(known, "content_hash", "left_anti")
    fresh = parse_pages(
        todo.select("content_hash", html_col).dropDuplicates(["content_hash"]), html_col=html_col, keep_html=False
    )
    fresh.select("content_hash", "nodes", "parse_error").write.mode("append").parquet(store_path)
    stored = spark.read.parquet(store_path).dropDuplicates(["content_hash"])
    return hashed.join(stored, "content_hash").drop("content_hash")
