"""Table schemas (StructTypes) shared by sources and operators."""

from __future__ import annotations

from pyspark.sql import types as T

STR = T.StringType()
INT = T.IntegerType()
LONG = T.LongType()

# One HTML node; ``id`` is the pre-order index (= array position) and the
# subtree of a node is nodes[id+1 .. end_id]. ``sib``/``type_sib`` are the
# 1-based positions among element siblings (all / same tag), ``prev_sib``
# the id of the previous element sibling, ``n_sib``/``n_type`` how many
# siblings there are with the node itself. ``kids`` counts its children but comments.
# ``up0``/``up1`` are the set of the ancestors' tags, a bit for each tag of
# ``functions.html.NESTING_TAGS``. ``start``/``stop`` are character offsets of the
# element's outer HTML in the source page.
NODE = T.StructType(
    [
        T.StructField("id", INT),
        T.StructField("parent", INT),
        T.StructField("end_id", INT),
        T.StructField("depth", INT),
        T.StructField("sib", INT),
        T.StructField("type_sib", INT),
        T.StructField("n_sib", INT),
        T.StructField("n_type", INT),
        T.StructField("prev_sib", INT),
        T.StructField("kids", INT),
        T.StructField("kind", STR),
        T.StructField("tag", STR),
        T.StructField("attrs", T.MapType(STR, STR)),
        T.StructField("text", STR),
        T.StructField("up0", LONG),
        T.StructField("up1", LONG),
        T.StructField("start", INT),
        T.StructField("stop", INT),
    ]
)
NODES = T.ArrayType(NODE)

PAGES = T.StructType(
    [T.StructField("page_id", LONG), T.StructField("url", STR), T.StructField("html", STR)]
)

LINK = T.StructType(
    [T.StructField("url", STR), T.StructField("text", STR), T.StructField("title", STR)]
)

# Sparse fetch metadata (every field nullable; null fields vanish in to_json).
FETCH_META = T.StructType(
    [
        T.StructField("elapsed_ms", T.DoubleType()),
        T.StructField("attempts", INT),
        T.StructField("retries", INT),
        T.StructField("from_cache", T.BooleanType()),
        T.StructField("proxy_used", T.BooleanType()),
        T.StructField("proxy_config", T.MapType(STR, STR)),
        T.StructField("headers", T.MapType(STR, STR)),
        T.StructField("rendered_js", T.BooleanType()),
        T.StructField("final_url", STR),
        T.StructField("cache_key", STR),
        T.StructField("css_selector_applied", STR),
        T.StructField("elements_matched", INT),
        T.StructField("page_metadata", T.MapType(STR, STR)),
    ]
)
