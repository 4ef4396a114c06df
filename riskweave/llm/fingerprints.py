"""Document fingerprints: SimHash and search by permuted block tables (DataFrame functions only).

Terms are runs of ``TERM_WORDS`` words; a term's weight is how often it occurs,
each occurrence adding a signed vote per bit. The fingerprint of a text depends
on the text alone. A text with fewer words is one term; a blank text has
fingerprint 0.

Search: fingerprints are cut into ``BLOCKS`` blocks. Within the radius at least
BLOCKS - radius blocks agree, so for each choice of that many blocks a table
keyed by them (a permutation that moves them in front) brings all such pairs
together; the exact distance then decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, scratch, shingle_rows, text_or_empty, words
from .simhash_bits import block_masks, distance, hex16, join_on_blocks, vote

TERM_WORDS = 2
RADIUS = 3
BLOCKS = 6
#: Rows whose id is divisible by this are searched for among all rows.
QUERY_EVERY = 20
#: Neighbouring documents are found within ranges of this many ids' texts, one task each.
RANGE_ROWS = 4000
MAX_RANGES = 10_000


def fingerprint_texts(texts: DataFrame, keys: list[str], text_col: str = "text", terms: int = TERM_WORDS) -> DataFrame:
    """(keys, text) -> (keys, fp), one row per distinct keys; rows that share keys must share the text."""
    parts = [f"w{i}" for i in range(terms)]
    w = texts.select(*keys, words(text_or_empty(text_col)).alias("_words"))
    t = w.select(*keys, F.explode_outer(shingle_rows("_words", terms, parts)).alias("_t"))
    h = t.select(*keys, F.when(F.col("_t").isNotNull(), F.xxhash64(*[F.col(f"_t.{p}") for p in parts])).alias("h"))
    return vote(h, keys)


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> adds ``next_text``: the text of the next row in descending doc_id (after the last: the first).

    Ids are cut into ranges at sampled quantiles. Each range's first row is also
    sent to the range before it, so a window inside every range sees the row that
    follows its last one; the texts move once and no task sees more than a range.
    Null ids come last; equal ids are ordered by text.
    """
    n = docs.count()
    count = min(MAX_RANGES, max(1, n // RANGE_ROWS))
    cuts = docs.select(F.percentile_approx("doc_id", [i / count for i in range(1, count)] or [0.5], 100_000)).first()[0]
    # range r holds ids above the r-th largest cut and up to the one before it
    cuts = sorted(set(cuts or []), reverse=True) if count > 1 else []
    least, most = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    last = len(cuts)
    edges = F.array(*[F.lit(c).cast("long") for c in cuts])
    r = F.size(F.filter(edges, lambda c: c >= F.col("doc_id"))) if cuts else F.lit(0)
    own = docs.select("doc_id", "text", F.when(F.col("doc_id").isNull(), F.lit(last)).otherwise(r).alias("range"),
                      F.lit(False).alias("guest"))
    # rows equal to a cut open their range; the overall first row follows the last range
    opens = F.array_position(edges, F.col("doc_id")) > 0 if cuts else F.lit(False)
    guests = docs.where(F.col("doc_id").isNotNull()).where(opens | (F.col("doc_id") == F.lit(most)))
    guests = guests.select("doc_id", "text", F.when(F.col("doc_id") == F.lit(most), F.lit(last)).otherwise(r - 1)
                           .alias("range"), F.lit(True).alias("guest"))
    order = Window.partitionBy("range").orderBy("guest", F.desc_nulls_last("doc_id"), F.coalesce("text", F.lit("")))
    if most is None:  # ids are all null: one range, and the first row by text follows the last
        first = docs.orderBy(F.coalesce("text", F.lit(""))).limit(1)
        guests = first.select("doc_id", "text", F.lit(0).alias("range"), F.lit(True).alias("guest"))
    both = own.unionByName(guests)
    led = both.withColumn("next_text", F.lead(F.coalesce("text", F.lit(""))).over(order))
    return led.where("NOT guest").select("doc_id", "text", "next_text")


def find_within(queries: DataFrame, fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Distinct fingerprints (fp) asked for, among distinct fingerprints (fp) -> all pairs (a asked, b another) within ``radius``."""
    if not 0 <= radius < blocks <= 64:
        raise ValueError("radius must be below blocks, blocks at most 64")

    def wanted(a: str, b: str) -> Column:
        return (F.col(f"{a}.fp") != F.col(f"{b}.fp")) & (distance(F.col(f"{a}.fp"), F.col(f"{b}.fp")) <= radius)

    return join_on_blocks(queries.select("fp", F.col("fp").alias("code")), fps.select("fp", F.col("fp").alias("code")),
                          block_masks(64, 1, blocks), blocks - radius, wanted)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return F.lit(1.0) - distance(a, b) / F.lit(64.0)


def fingerprint_documents(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, n_within (other rows within ``radius`` bits of the row's fingerprint; asked for the rows
    whose id is divisible by ``QUERY_EVERY``, null for the rest).

    The edited text has its last third replaced by the start of the next
    document (see ``with_next``). Null text counts as empty; an empty table gives no rows; a single
    row is its own next document. Other columns of ``docs`` are ignored.
    """
    led = with_next(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")))
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    led = led.select(F.monotonically_increasing_id().alias("row"), "doc_id", n.cast("long").alias("n_chars"),
                     "text", edited.alias("edited"), "next_text")

    def digest(c: str) -> Column:
        return F.unhex(F.sha2(c, 256))

    # the original's row carries the document's facts, the edited text's row only its digest
    none = F.lit(None)
    both = led.select("row", F.explode(F.array(
        F.struct(F.lit(0).alias("which"), F.col("doc_id"), F.col("n_chars"), digest("text").alias("own"),
                 digest("next_text").alias("following"), F.col("text").alias("body")),
        F.struct(F.lit(1).alias("which"), none.cast("long").alias("doc_id"), none.cast("long").alias("n_chars"),
                 digest("edited").alias("own"), none.cast("binary").alias("following"), F.col("edited").alias("body")),
    )).alias("v")).select("row", "v.*").withColumnRenamed("body", "text")
    votes = fingerprint_texts(both, ["row", "which", "doc_id", "n_chars", "own", "following"])

    def of(which: int, col: str) -> Column:
        return F.max(F.when(F.col("which") == which, F.col(col)))

    rows = scratch(votes.groupBy("row").agg(
        of(0, "doc_id").alias("doc_id"), of(0, "n_chars").alias("n_chars"), of(0, "own").alias("own"),
        of(0, "following").alias("following"), of(0, "fp").alias("fp"), of(1, "fp").alias("edited_fp"),
        of(1, "own").alias("edited")), "fingerprints")
    total = rows.count()
    by_text = rows.groupBy("own").agg(F.first("fp").alias("next_fp"), F.count(F.lit(1)).alias("n_next")) \
        .withColumnRenamed("own", "following")
    rows_next = attach(rows, by_text, "following", "n_next", total)
    per_fp = scratch(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "fingerprints-distinct")
    queries = rows.where(F.col("doc_id") % QUERY_EVERY == 0).select("fp").distinct()
    near = find_within(queries, per_fp.select("fp"), radius).join(per_fp.withColumnRenamed("fp", "b"), "b") \
        .groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("n_near"))
    counts = per_fp.join(near, "fp", "left").select("fp", F.col("n").alias("n_same"),
                                                    F.coalesce("n_near", F.lit(0)).alias("n_near"))
    out = attach(rows_next, counts.where("n_same > 1 OR n_near > 0"), "fp", "n_same", total)
    return out.select(
        "doc_id", "n_chars", F.lower(F.hex("edited")).alias("edited_sha256"), hex16("fp").alias("fingerprint"),
        hex16("edited_fp").alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.when(F.col("doc_id") % QUERY_EVERY == 0,
               (F.coalesce("n_same", F.lit(1)) - 1 + F.coalesce("n_near", F.lit(0))).cast("long")).alias("n_within"))
