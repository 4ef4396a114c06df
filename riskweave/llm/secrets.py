"""Secret scan with multipart credential linking (DataFrame functions only).

Every text is scanned once per kind; match positions come from the pieces
between matches, so offsets are code points. Base kinds are always reported.
Weak kinds (account identifiers, opaque tokens, endpoints) are reported only
when a complementary part lies within ``scope`` code points of the text:

    identifier (weak ident, access key) <-> secret (assign, hex, weak opaque)
    endpoint                             -> a secret
    weak opaque                          -> an identifier or an endpoint

The link is an interval join on the parts of a text: for every part, the nearest
complementary interval before and after it (running maximum of ends, running
minimum of starts) decides whether any lies within the scope. A text's parts are
ordered once, so a text with very many parts costs n log n and no pair is listed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, scratch, text_or_empty


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_VALUE = "[A-Za-z0-9+/_.=-]"
_BIND = "[\"']?\\x20*[:=]\\x20*[\"']?"
_NAMES = "|".join([*(_any_case(x) for x in ("password", "passwd", "secret", "token")), f"{_any_case('api')}_?{_any_case('key')}"])
_ACCOUNTS = "|".join(f"{_any_case(x)}" for x in (
    "username", "user", "login", "account", "client_id", "access_key_id"))

#: Plain strings one of which every match of the kind holds, lower-cased: a text without them is not searched.
MARKS = {
    "assign": ("passw", "secret", "token", "api"), "access": ("akia",), "hex": (),
    "ident": ("user", "login", "account", "client_id", "access_key_id"), "opaque": (), "endpoint": ("://",),
}
#: Kinds in report order. Pattern, then what a match must also satisfy.
PATTERNS = {
    "assign": f"(?:{_NAMES}){_BIND}{_VALUE}+",
    "access": "AKIA[A-Z0-9]{12,}",
    "hex": "[0-9a-f]{32,}",
    "ident": f"(?:{_ACCOUNTS}){_BIND}[A-Za-z0-9._@-]{{3,}}",
    "opaque": "[A-Za-z0-9+/_=-]{20,}",
    "endpoint": "(?:[Hh][Tt][Tt][Pp][Ss]?|[Ff][Tt][Pp]|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|mongodb|amqp)"
                "://[^\\x00-\\x20\"'<>]+",
}
BASE = ("assign", "access", "hex")
KINDS = tuple(PATTERNS)
#: The name and binding of an assignment, cut off to measure its value.
ASSIGN_HEAD = f"^(?:{_NAMES}){_BIND}"
LEAST_VALUE = 8
SCOPE = 200
MASK = "[SECRET]"

_PARTS = "array<struct<start:bigint,rank:int,end:bigint>>"


def _keep(kind: str, match: Column) -> Column:
    if kind == "assign":
        return F.char_length(F.regexp_replace(match, ASSIGN_HEAD, "")) >= LEAST_VALUE
    if kind == "opaque":
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]")
    return F.lit(True)


def _found(text: Column, kind: str, worth: Column | None = None) -> Column:
    """Sorted array of (start, rank, end) of the kind's matches in ``text``; empty unless ``worth``.

    Text pieces between the matches alternate with the matches, so running
    sums of their lengths are the offsets.
    """
    pattern = PATTERNS[kind]
    hit = text.rlike(pattern)
    if MARKS[kind]:
        marks = [F.contains(F.col("_lower"), F.lit(m)) for m in MARKS[kind]]
        hit = reduce(lambda x, y: x | y, marks) & hit
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.char_length(p).cast("long"))
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lens = F.zip_with(matches, gaps, lambda m, g: F.struct(
        m.alias("m"), g.alias("gap"), F.char_length(m).cast("long").alias("len")))
    lens = F.filter(lens, lambda x: x["m"].isNotNull())
    empty = F.array().cast(_PARTS)
    walked = F.aggregate(
        lens, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["len"]).alias("at"),
            F.when(_keep(kind, x["m"]), F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + x["gap"]).alias("start"), F.lit(KINDS.index(kind)).alias("rank"),
                (acc["at"] + x["gap"] + x["len"]).alias("end"))))).otherwise(acc["out"]).alias("out")),
        lambda acc: acc["out"])
    return F.when(hit if worth is None else worth & hit, walked).otherwise(empty)


def find_parts(docs: DataFrame, text: Column) -> DataFrame:
    """Adds ``_base`` and ``_weak``: sorted arrays of (start, rank, end), rank being the kind's place in KINDS.

    Opaque tokens are looked for only where an identifier or endpoint could
    complement them; where there is none they could never be reported.
    """
    found = docs.withColumn("_lower", F.lower(text)).withColumns({f"_{k}": _found(text, k) for k in ("assign", "access", "hex", "ident", "endpoint")})
    anchored = (F.size("_ident") > 0) | (F.size("_endpoint") > 0) | (F.size("_access") > 0)
    found = found.withColumn("_opaque", _found(text, "opaque", anchored))
    return found.withColumns({
        "_base": F.array_sort(F.concat("_assign", "_access", "_hex")),
        "_weak": F.array_sort(F.concat("_ident", "_opaque", "_endpoint"))})


def _flags(*kinds: str) -> Column:
    return F.col("rank").isin([KINDS.index(k) for k in kinds])


def link_weak(parts: DataFrame, scope: int = SCOPE, overlapping: bool = False) -> DataFrame:
    """(key, start, rank, end) parts of texts -> the weak ones that a complementary part completes.

    A weak part that overlaps a base span adds nothing and is left out, and so
    is an opaque token inside an identifier or endpoint. With ``overlapping`` a weak part is
    left out only if it lies wholly inside a base span; one that reaches beyond it stays, and
    a secret that it holds or touches completes it.
    """
    order = Window.partitionBy("key").orderBy("start", "rank", "end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(1, Window.unboundedFollowing)

    def near(flag: Column, gap: int) -> Column:
        """A flagged interval lies within ``gap`` of this one (gap -1: shares a code point)."""
        back = F.max(F.when(flag, F.col("end"))).over(before)
        ahead = F.min(F.when(flag, F.col("start"))).over(after)
        return F.coalesce(F.col("start") - back <= gap, F.lit(False)) | F.coalesce(ahead - F.col("end") <= gap, F.lit(False))

    base, named = _flags(*BASE), _flags("ident", "endpoint")
    # tokens that are only part of a base span, a name or an address count for nothing
    # (a base span that starts where a weak part does is ordered before it)
    inside = F.coalesce(F.max(F.when(base, F.col("end"))).over(before) >= F.col("end"), F.lit(False))
    free = parts.withColumn("covered", (inside if overlapping else near(base, -1)) | (_flags("opaque") & near(named, -1)))
    free = free.where(~F.col("covered") | base)
    secret, identifier, endpoint = _flags("assign", "hex", "opaque"), _flags("ident", "access"), _flags("endpoint")
    linked = free.withColumn("completed", F.when(identifier | endpoint, near(secret, scope))
                             .otherwise(near(identifier | endpoint, scope)))
    return linked.where(F.col("completed") & ~base).select("key", "start", "rank", "end")


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, scope: int = SCOPE, keep: list[str] | None = None, overlapping: bool = False) -> DataFrame:
    """Adds ``spans`` (sorted array of start, rank, end) and ``base`` (the same, base kinds only) to the
    columns ``keep`` of ``docs`` (all by default). ``overlapping``: see ``link_weak``.

    Null text counts as empty and has no spans. Equal texts are linked once, so
    groups of copies cost one text. Rows are neither dropped nor merged; columns
    of the input named like an output column are replaced.
    """
    keep = docs.columns if keep is None else keep
    keep = [c for c in keep if c not in ("spans", "base")]
    found = find_parts(docs, text_or_empty())
    found = scratch(found.select(*keep, "_base", "_weak", F.when(F.size("_weak") > 0, F.sha2(text_or_empty(), 256))
                                 .alias("_key")), "secret-parts")
    plain = found.where("_key IS NULL").select(*keep, F.col("_base").alias("base"), F.col("_base").alias("spans"))
    parts = found.where("_key IS NOT NULL").groupBy("_key").agg(
        F.first("_base").alias("_base"), F.first("_weak").alias("_weak"))
    linked = link_weak(parts.select(F.col("_key").alias("key"), F.explode(F.concat("_base", "_weak")).alias("p"))
                       .select("key", "p.start", "p.rank", "p.end"), scope, overlapping)
    per_text = linked.groupBy(F.col("key").alias("_key")).agg(F.collect_list(F.struct("start", "rank", "end")).alias("_linked"))
    sizes = found.where("_key IS NOT NULL").groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    per_text = scratch(per_text.join(sizes, "_key"), "secret-links")
    total = per_text.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    weak = attach(found.where("_key IS NOT NULL"), per_text, "_key", "_n", total).select(
        *keep, F.col("_base").alias("base"),
        F.when(F.col("_linked").isNull(), F.col("_base"))
        .otherwise(F.array_sort(F.concat("_base", "_linked"))).alias("spans"))
    return plain.unionByName(weak)


def report(scanned: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans as text."""
    def n(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", *[n(k) for k in BASE], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
                          _listed(F.col("spans")).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """``text`` with every run of overlapping spans replaced by MASK (null stays null)."""
    done = F.aggregate(
        spans, F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(
                acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                F.lit(MASK))).otherwise(acc["out"]).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
