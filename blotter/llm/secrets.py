"""Secret scanning with multipart credential linking, in DataFrame functions only.

Base spans come from three patterns (assignments, access identifiers, hex runs), leftmost and non-overlapping per kind.
On top, weak parts are collected: identifiers, secrets and endpoints that mean nothing alone. A scope is a stretch of
``scope`` characters; parts whose starts are at most that far apart in one document lie in one scope. A weak identifier is
reported if a secret lies in its scope, a weak secret if an identifier does, an endpoint if both do. Weak parts that
overlap a base span are dropped.

The interval join runs over buckets of one scope's width. All parts of a document's bucket are reduced to their smallest
and largest start per role before they meet their neighbours, so a part meets one row, never every other part.

Null texts count as empty: no spans. Repeated rows (same identifier, same text) get the same spans each. Null
identifiers are a value like any other. Positions count code points, ends are exclusive, texts are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blotter.llm.common import fresh_name, quoted, text_or_empty
from blotter.session import cut_lineage


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    role: str  # id, secret or endpoint
    weak: bool
    valid: tuple[str, ...] = ()  # patterns that a whole match must hold


# The base patterns and the order of the kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (
    Kind("assign", ASSIGN, "secret", False, ("^" + ASSIGN.removesuffix("+)") + "{8,})$",)),
    Kind("access", r"AKIA[A-Z0-9]+", "id", False, (r"^.{16,}$",)),
    Kind("hex", r"[0-9a-f]{32,}", "secret", False),
    Kind("weak_id", r"""(?i)(client_?id|access_?key_?id|account_?id|key_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", "id", True),
    Kind("weak_secret", r"[A-Za-z0-9+/]{32,}={0,2}", "secret", True, (r"[a-z]", r"[A-Z]", r"[0-9]")),
    Kind("weak_pass", r"""(?i)(pwd|passphrase|pass|auth|key)["']?\x20*[:=]\x20*["']?[^\x20\x09-\x0D"']{6,}""", "secret", True),
    Kind("endpoint", r"""(?i)https?://[A-Za-z0-9.-]+|(endpoint|host|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9][A-Za-z0-9.:/-]+""", "endpoint", True),
)
BASE = sum(not k.weak for k in KINDS)
SCOPE = 400
#: Matches whose spans are listed one after the other.
STRETCH = 256
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _located(text: Column, kind: Kind, index: int) -> Column:
    """Spans of a kind: the pieces between matches and the matches themselves, laid end to end.

    Lists only grow within stretches of ``STRETCH`` matches, whose own starts are added afterwards, so the time does not
    grow with the square of the matches.
    """
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    laid = F.zip_with(F.split(text, kind.pattern, -1), matches, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.coalesce(F.length(hit), F.lit(0)).alias("size"), _good(hit, kind).alias("good")))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + x["size"]
        span = F.array(F.struct(start.alias("start"), F.lit(index).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["good"], F.concat(state["out"], span)).otherwise(state["out"]).alias("out"))

    none = F.array().cast(SPAN)
    stretch = lambda part: F.aggregate(part, F.struct(F.lit(0).alias("at"), none.alias("out")), step)
    # Bound to a lambda's variable, the list is made once and not for each stretch.
    cut = lambda whole: F.transform(F.sequence(F.lit(1), F.greatest(F.size(whole), F.lit(1)), F.lit(STRETCH)), lambda i: stretch(F.slice(whole, i, STRETCH)))
    parts = F.get(F.transform(F.array(laid), cut), F.lit(0))

    def moved(state: Column, part: Column) -> Column:
        at = state["at"]
        shifted = F.transform(part["out"], lambda s: F.struct((s["start"] + at).alias("start"), s["kind"].alias("kind"), (s["end"] + at).alias("end")))
        return F.struct((at + part["at"]).alias("at"), F.concat(state["out"], F.array(shifted)).alias("out"))

    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")), moved, lambda s: F.flatten(s["out"]))
    return F.when(text.rlike(kind.pattern), found).otherwise(none)


def _good(hit: Column, kind: Kind) -> Column:
    good = hit.isNotNull()
    for needed in kind.valid:
        good = good & hit.rlike(needed)
    return good


def _same(left: str, right: str) -> Column:
    return F.col(f"{left}._d").eqNullSafe(F.col(f"{right}._d")) & (F.col(f"{left}._h") == F.col(f"{right}._h"))


def _free(rows: DataFrame, scope: int) -> DataFrame:
    """The weak parts (``_d``, ``_h``, ``p``) of ``rows`` that overlap no base span, compared within stretches of ``scope``."""
    touched = lambda p: F.explode(F.sequence(F.floor(F.col(f"{p}.start") / scope), F.floor((F.col(f"{p}.end") - 1) / scope))).alias("bucket")
    weak = rows.filter(F.size("weak") > 0).select("_d", "_h", F.explode("weak").alias("p"))
    base = rows.filter((F.size("weak") > 0) & (F.size("base") > 0)).select("_d", "_h", F.explode("base").alias("b"))
    # Base spans of a kind don't overlap, so a stretch holds a bounded number of them.
    held = base.select("_d", "_h", "b", touched("b")).groupBy("_d", "_h", "bucket").agg(F.collect_list("b").alias("held"))
    met = weak.select("_d", "_h", "p", touched("p")).alias("w").join(held.alias("b"), _same("w", "b") & (F.col("w.bucket") == F.col("b.bucket")))
    met = met.filter(F.exists("held", lambda b: (b["start"] < F.col("p.end")) & (F.col("p.start") < b["end"]))).select("w._d", "w._h", "p")
    return weak.alias("w").join(met.distinct().alias("m"), _same("w", "m") & (F.col("w.p") == F.col("m.p")), "left_anti")


def spans(docs: DataFrame, scope: int = SCOPE, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None, out: str = "spans") -> DataFrame:
    """Columns ``keep`` of ``docs`` (default: all) with ``out``, each row's spans ordered by start, kind and end.

    A span is ``(start, kind, end)``, ``kind`` an index into ``KINDS``. The patterns run once over every text; only
    identifiers, a text hash and spans are written to the shared folder and shuffled.
    """
    keep = docs.columns if keep is None else keep
    base, weak = (F.concat(*(_located(F.col("_t"), k, i) for i, k in enumerate(KINDS) if k.weak == side)) for side in (False, True))
    key = docs.select(F.col(quoted(doc_id)).alias("_d"), text_or_empty(quoted(text)).alias("_t"))
    rows = key.select("_d", F.xxhash64("_t").alias("_h"), base.alias("base"), weak.alias("weak"))
    rows = cut_lineage(rows.filter((F.size("base") > 0) | (F.size("weak") > 0)).distinct())

    role = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (i, k.role)))[F.col("p.kind")]
    parts = rows.filter(F.size("weak") > 0).select("_d", "_h", F.explode("base").alias("p")).unionByName(_free(rows, scope))
    parts = parts.select("_d", "_h", "p", role.alias("role"), F.col("p.start").alias("at"), F.floor(F.col("p.start") / scope).alias("bucket"))
    ends = parts.groupBy("_d", "_h", "bucket").agg(
        *(f(F.when(F.col("role") == r, F.col("at"))).alias(f"{r}_{n}") for r in ("id", "secret") for f, n in ((F.min, "first"), (F.max, "last")))
    )
    # A bucket's extremes go to itself and to both neighbours; what lies in the bucket itself is always in reach.
    seen = ends.select("_d", "_h", F.explode(F.array(*(F.col("bucket") + i for i in (-1, 0, 1)))).alias("to"), *(c for c in ends.columns if c not in ("_d", "_h")))
    reach = seen.groupBy("_d", "_h", F.col("to").alias("bucket")).agg(
        *(
            e.alias(f"{r}_{n}")
            for r in ("id", "secret")
            for n, e in (
                ("before", F.max(F.when(F.col("bucket") < F.col("to"), F.col(f"{r}_last")))),
                ("here", F.max(F.when(F.col("bucket") == F.col("to"), F.col(f"{r}_last")))),
                ("after", F.min(F.when(F.col("bucket") > F.col("to"), F.col(f"{r}_first")))),
            )
        )
    )

    def near(r: str) -> Column:
        return F.coalesce(
            F.col(f"{r}_here").isNotNull() | (F.col("at") - F.col(f"{r}_before") <= scope) | (F.col(f"{r}_after") - F.col("at") <= scope), F.lit(False)
        )

    candidates = parts.filter(F.col("p.kind") >= BASE).alias("c")
    reach = reach.alias("r")
    same = F.col("c._d").eqNullSafe(F.col("r._d")) & (F.col("c._h") == F.col("r._h")) & (F.col("c.bucket") == F.col("r.bucket"))
    linked = candidates.join(reach, same).filter(
        F.when(F.col("role") == "id", near("secret")).when(F.col("role") == "secret", near("id")).otherwise(near("id") & near("secret"))
    )
    added = linked.groupBy("c._d", "c._h").agg(F.collect_set("p").alias("added"))
    found = rows.alias("f").join(added.alias("a"), F.col("f._d").eqNullSafe(F.col("a._d")) & (F.col("f._h") == F.col("a._h")), "left").select(
        F.col("f._d"), F.col("f._h"), F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(SPAN)))).alias("_s")
    )
    name = fresh_name(docs.select(*map(quoted, keep)), out)
    left = docs.select(F.struct(*map(quoted, keep)).alias("_row"), F.col(quoted(doc_id)).alias("_d"), F.xxhash64(text_or_empty(quoted(text))).alias("_h")).alias("l")
    joined = left.join(found.alias("f"), F.col("l._d").eqNullSafe(F.col("f._d")) & (F.col("l._h") == F.col("f._h")), "left")
    return joined.select("_row.*", F.coalesce("_s", F.array().cast(SPAN)).alias(name))


def as_text(found: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*(F.lit(k.name) for k in KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark``; overlapping spans become one mark."""
    name = fresh_name(docs, "_found")
    found = spans(docs, text=text, out=name, **options)
    whole, where = F.col(quoted(text)), F.col(name)
    none = F.array().cast("array<string>")

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(whole, state["at"] + 1, s["start"] - state["at"])
        more = F.when(s["start"] >= state["at"], F.concat(state["out"], F.array(gap, F.lit(mark)))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), more.alias("out"))

    cut = F.aggregate(where, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(whole, s["at"] + 1, F.length(whole))))
    return found.withColumn(text, F.when(F.size(where) > 0, cut).otherwise(whole)).select(*map(quoted, docs.columns))
