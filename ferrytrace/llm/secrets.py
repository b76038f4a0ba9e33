"""Secret scan that links the parts of a credential: identifiers, secrets and endpoints.

Some spans speak for themselves (an access key id, an assignment to ``password``, a long hexadecimal
string) and are always reported.  Others are weak: an identifier-like assignment, a mixed random
string, an address.  A weak span is reported only when a complementary part lies in its scope, that
is within ``scope`` code points in the same text: identifiers and endpoints need a secret, a random
string needs an identifier or an endpoint.

DataFrame functions only.  Patterns are matched where the text is read; from then on only the spans
travel.  All spans of a row are ordered by place, and running bounds over that order answer the
interval join: is there a complement that ends late enough before, or starts early enough after?
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrytrace.llm.common import ids_and_text

# Kinds in the order in which spans that start together are listed.
KINDS = ["assign", "access", "hex", "id", "endpoint", "random"]
BASE = KINDS[:3]
IDENTIFIERS, SECRETS, ENDPOINTS = ["access", "id"], ["assign", "hex", "random"], ["endpoint"]

# Fixed: the patterns of the spans that are always reported; ``assign`` needs 6 characters of value.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
# Runs are taken whole, so asking for the length in the pattern drops just the short matches.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

PATTERNS = {
    "assign": ASSIGN,
    "access": ACCESS,
    "hex": HEX,
    "id": r"(?<![A-Za-z0-9_])(?i:client_?id|access_?key(?:_?id)?|account(?:_?id)?|username|login)"
    r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""",
    "endpoint": r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,15}://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+",
    "random": r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/=_-]*+[0-9])(?=[A-Z0-9+/=_-]*+[a-z])(?=[a-z0-9+/=_-]*+[A-Z])"
    r"[A-Za-z0-9+/=_-]{20,}",
}
SCOPE = 200


def _matches(text: Column, kind: str) -> Column:
    """All matches of a kind: how many code points lie before each since the last one, its length."""
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def part(match: Column, at: Column) -> Column:
        keep = F.lit(True)
        if kind == "assign":
            keep = F.length(F.regexp_extract(match, pattern, 2)) >= ASSIGN_VALUE
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            at.cast("long").alias("at"),
            F.length(F.get(gaps, at)).cast("long").alias("gap"),
            F.length(match).cast("long").alias("size"),
            keep.alias("keep"),
        )

    nothing = F.lit(None)
    return F.coalesce(F.when(F.rlike(text, F.lit(pattern)), F.transform(found, part)).otherwise(nothing), F.array())


def _in(kinds: list[str]) -> Column:
    return F.col("kind").isin([KINDS.index(k) for k in kinds])


def _listed(spans: Column) -> Column:
    """``kind:start:end`` of the spans in order, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def find_secrets(
    docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE
) -> DataFrame:
    """Per document: ``doc_id`` and ``spans``, an array of (start, kind, end) in code points, end
    exclusive, ordered; ``kind`` is an index of ``KINDS``.

    A null text is empty and has no spans.  Repeated rows and rows with equal or null ids are kept
    apart; other columns are ignored; an empty table gives none.  A weak span that overlaps a span of
    a stronger kind is part of that one and is neither reported nor a complement.
    """
    narrow = ids_and_text(docs, key, text).withColumn("row", F.monotonically_increasing_id())
    content = F.coalesce(F.col("text"), F.lit(""))
    parts = F.concat(*[_matches(content, k) for k in KINDS])
    rows = narrow.select("row", "doc_id", F.explode_outer(parts).alias("p"))
    rows = rows.select("row", "doc_id", "p.*")

    # Places: the sum of all gaps and matches of the kind before.
    earlier = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.sum(F.col("gap") + F.col("size")).over(earlier)
    spans = rows.withColumn("end", ends).withColumn("start", F.col("end") - F.col("size"))

    # Weak spans inside stronger ones fall away: base kinds first, then endpoints, then identifiers.
    order = Window.partitionBy("row").orderBy("start", "kind", "end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(1, Window.unboundedFollowing)
    live = F.col("keep") & ~F.col("covered")

    def overlapped(kinds: list[str]) -> Column:
        on = _in(kinds) & live
        ended = F.max(F.when(on, F.col("end"))).over(before)
        starts = F.min(F.when(on, F.col("start"))).over(after)
        return F.coalesce(ended > F.col("start"), F.lit(False)) | F.coalesce(starts < F.col("end"), F.lit(False))

    spans = spans.withColumn("covered", F.lit(False))
    for stronger, weaker in ((BASE, ["id", "endpoint", "random"]), (["endpoint"], ["id", "random"]), (["id"], ["random"])):
        spans = spans.withColumn("covered", F.col("covered") | (_in(weaker) & overlapped(stronger)))

    def near(kinds: list[str]) -> Column:
        on = _in(kinds) & live
        ended = F.max(F.when(on, F.col("end"))).over(before)
        starts = F.min(F.when(on, F.col("start"))).over(after)
        return F.coalesce(ended >= F.col("start") - scope, F.lit(False)) | F.coalesce(
            starts <= F.col("end") + scope, F.lit(False)
        )

    linked = F.when(_in(["id", "endpoint"]), near(SECRETS)).when(
        _in(["random"]), near(IDENTIFIERS + ENDPOINTS)
    )
    kept = spans.withColumn("kept", live & (_in(BASE) | F.coalesce(linked, F.lit(False))))
    span = F.when(F.col("kept"), F.struct("start", "kind", "end"))
    return (
        kept.groupBy("row")
        .agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(span)).alias("spans"))
        .select("doc_id", "spans")
    )


def report(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, all spans as text."""

    def of(kinds: list[str]) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin([KINDS.index(k) for k in kinds]))

    return found.select(
        "doc_id",
        *[F.size(of([k])).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_listed(of(BASE)).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        F.size(of(KINDS[3:])).cast("long").alias("n_linked"),
    )
