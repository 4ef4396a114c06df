"""SimHash near-duplicates by segment-popcount embedding.

Method. A fingerprint is cut into 32 segments of two bits; its embedding is the
vector of bit counts (0 to 2) per segment. The Manhattan distance of two
embeddings never exceeds the Hamming distance of the fingerprints, so pairs
further apart than the radius in the embedding need no look at the bits. The
vectors are written in thermometer code (each segment's bits sorted), where the
Manhattan distance is one popcount of an exclusive or.

Grid. The 32 coordinates form ``radius + AGREE`` blocks. A Manhattan distance of at
most ``radius`` leaves at least three blocks untouched, so both points fall into
the same grid cell of some triple of blocks; joining on the cells of all triples
finds every pair within range. Inside a cell the join keeps pairs within
Manhattan range, then within the exact Hamming range. Copies collapse into one fingerprint before the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, lower_ascii, scratch, shingle_rows, text_or_empty, words
from .components import connected_components
from .simhash_bits import block_masks, chain_on_blocks, distance, hex16, join_on_blocks, vote

SEGMENTS = 32
#: Blocks that pairs within the radius share; sets how many points meet in a cell.
AGREE = 3
_ODD = 0x5555555555555555


def fingerprints(docs: DataFrame, shingle: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp) and the columns ``carry``: SimHash over XXH64 (seed 42) of word shingles.

    Null or blank text: fingerprint 0. Repeated rows stay separate rows.
    """
    parts = [f"w{i}" for i in range(shingle)]
    keys = ["_row", "doc_id", *carry]
    w = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", *carry,
                    words(lower_ascii(text_or_empty())).alias("_words"))
    sh = w.select(*keys, F.explode_outer(shingle_rows("_words", shingle, parts)).alias("_s"))
    joined = F.concat_ws(" ", *[F.col(f"_s.{p}") for p in parts])
    h = sh.select(*keys, F.when(F.col("_s").isNotNull(), F.xxhash64(joined)).alias("h"))
    return vote(h, keys).select("doc_id", *carry, "fp")


def _thermometer(fp: Column) -> Column:
    hi = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_ODD))
    lo = fp.bitwiseAND(F.lit(_ODD))
    return hi.bitwiseOR(lo).bitwiseOR(F.shiftleft(hi.bitwiseAND(lo), 1))


def group_fingerprints(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Distinct fingerprints (fp) -> (node, label) of every fp linked to another: label names its connected component.

    A group of m near copies has up to m squared links, so they are not all
    listed. First, neighbours in fingerprint order inside each grid cell are
    linked (at most one link per point and cell) and the components of these
    links found. Then the grid join lists the links between points of different
    components only, which joins what is still apart. Both steps together
    connect exactly what all links connect.
    """
    if not 0 <= radius <= SEGMENTS - AGREE:
        raise ValueError("radius must be between 0 and 29")
    masks = block_masks(SEGMENTS, 2, radius + AGREE)

    def close(code_a: Column, code_b: Column, fp_a: Column, fp_b: Column) -> Column:
        # the Manhattan distance of the embeddings first, then the bits themselves
        return (distance(code_a, code_b) <= radius) & (distance(fp_a, fp_b) <= radius)

    points = fps.select("fp", _thermometer(F.col("fp")).alias("code"))
    chained = scratch(chain_on_blocks(points, masks, AGREE, close), "simhash-chains")
    first = scratch(connected_components(chained), "simhash-groups")
    grouped = points.join(first.withColumnRenamed("node", "fp"), "fp", "left") \
        .select("fp", "code", F.coalesce("label", "fp").alias("grp"))

    def wanted(a: str, b: str) -> Column:
        return ((F.col(f"{a}.fp") < F.col(f"{b}.fp")) & (F.col(f"{a}.grp") != F.col(f"{b}.grp"))
                & close(F.col(f"{a}.code"), F.col(f"{b}.code"), F.col(f"{a}.fp"), F.col(f"{b}.fp")))

    across = scratch(join_on_blocks(grouped, grouped, masks, AGREE, wanted), "simhash-links")
    if not across.limit(1).count():
        return first
    return connected_components(chained.unionByName(across))


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, the columns ``carry``, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id among all rows whose fingerprints are
    connected by links of at most ``radius`` differing bits. Null ids are
    ignored in that minimum (a component of null ids only has a null
    component_id). Blank texts share fingerprint 0. An empty table gives no rows.
    """
    rows = scratch(fingerprints(docs, shingle, carry), "simhash")
    per_fp = scratch(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")),
                     "simhash-distinct")
    comps = group_fingerprints(per_fp.select("fp"), radius)
    linked = per_fp.join(comps, per_fp["fp"] == comps["node"]).select("fp", "label", "first_id", "n")
    smallest = linked.groupBy("label").agg(F.min("first_id").alias("component_id"))
    merged = linked.join(smallest, "label").select("fp", "component_id", "n")
    alone = per_fp.join(comps, per_fp["fp"] == comps["node"], "left_anti").where("n > 1") \
        .select("fp", F.col("first_id").alias("component_id"), "n")
    total = per_fp.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # fingerprints that stand alone need no lookup: their component is the row itself
    known = attach(rows, merged.unionByName(alone), "fp", "n", total)
    return known.select("doc_id", *carry, hex16("fp").alias("fingerprint"),
                        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
                        .alias("component_id"))
