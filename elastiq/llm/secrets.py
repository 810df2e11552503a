"""Secret scans with corpus-wide ownership frequency.

Only DataFrame functions. Patterns give candidates; what tells an example from a credential is who has it. Every
candidate's hash is counted over the corpus: in how many documents (repositories) and for how many sources (owners) it
occurs. One that several owners have is a widely copied example. One that looks random and belongs to one owner is live, however
many documents of that owner repeat it; so is one of which a second owner has only a small share of the documents. Verdicts depend
on owners and shares alone, so they are the same in a corpus of any size.

The patterns of ``BASE`` always count. The wide pattern ``owned`` (long runs that mix digits, small and
capital letters) would be noise alone: it only counts where ownership says live, and outside base spans.

Positions come from splitting a text at its matches: lengths of what lies before, summed by a window over the
matches of one document. Spans in order of their start tell by running limits which wide ones a base span covers, so a text full of
keys takes no pairs of spans. Texts without a match never leave the scan. Ownership is counted in three steps, each with partial
aggregation, so a value that a third of all documents have is a few rows per task.

Defined results: null text is empty and has no span; a null source is an owner of its own; equal rows count as one
document and have equal results; a null doc_id is a document of its own per text; other columns are ignored; an empty
table gives an empty result. Long texts are searched whole, with memory for one text and its spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from elastiq.llm.common import fresh
from elastiq.sources.staging import stage

_ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
# kind: pattern, group of the secret itself, least length of that group
BASE = {"assign": (_ASSIGN, 2, 12), "access": (r"AKIA[A-Z0-9]+", 0, 18), "hex": (r"[0-9a-f]{16,}", 0, 16)}
WIDE = {"owned": (r"[A-Za-z0-9+/_-]{20,}", 0, 20)}
KINDS = {**BASE, **WIDE}
VERDICTS = ("live", "shared", "example")
_KEY = ["doc_id", "text_hash"]


def _mixed(value: Column) -> Column:
    """Digits, small and capital letters, in turns: as keys are, and words, paths and numbers are not."""
    some = [value.rlike(x) for x in ("[0-9]", "[a-z]", "[A-Z]")]
    return some[0] & some[1] & some[2] & (F.regexp_count(value, F.lit("[0-9][A-Za-z]|[A-Za-z][0-9]")) >= 3)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, source, kind, start, stop (code points, leftmost matches), secret."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "source", "text")
    found = []
    for kind, (pattern, group, least) in KINDS.items():
        one = F.arrays_zip(
            F.transform(F.split("text", pattern), F.length).alias("gap"),
            F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.length).alias("long"),
            F.regexp_extract_all("text", F.lit(pattern), F.lit(group)).alias("secret"),
        )
        # The piece behind the last match has no match and drops out; where nothing matches, so does the text.
        found.append(F.when(F.col("text").rlike(pattern), F.struct(F.lit(kind).alias("kind"), one.alias("m"))))
    by_kind = texts.select(*_KEY, "source", F.explode(F.array_compact(F.array(*found))).alias("k"))
    each = by_kind.select(*_KEY, "source", "k.kind", F.posexplode("k.m").alias("place", "m"))
    each = each.filter(F.col("m.long").isNotNull()).select(*_KEY, "source", "kind", "place", "m.*").distinct()
    until = Window.partitionBy(*_KEY, "source", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.col("long")).over(until)
    each = each.withColumn("stop", stop.cast("bigint")).withColumn("start", F.col("stop") - F.col("long"))
    least = F.element_at(F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[2])]), F.col("kind"))
    good = (F.length("secret") >= least) & ((F.col("kind") != "owned") | _mixed(F.col("secret")))
    return each.filter(good).select(*_KEY, "source", "kind", "start", "stop", "secret")


def ownership(found: DataFrame) -> DataFrame:
    """secret_hash, n_owners, n_documents over the corpus, and the documents of the owner that has most."""
    own = found.groupBy("secret_hash", "source", *_KEY).agg(F.count(F.lit(1)).alias("n"))
    own = own.groupBy("secret_hash", "source").agg(F.count(F.lit(1)).alias("n"))
    most = F.max("n").alias("n_most")
    return own.groupBy("secret_hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_documents"), most)


def find_secrets(docs: DataFrame, example_owners: int = 3, main_share: float = 0.75) -> DataFrame:
    """doc_id, text_hash and ``spans``: kind, start, stop, verdict, n_owners, n_documents, in order; only documents that have some.

    verdict: ``example`` if at least ``example_owners`` sources have the value; ``live`` if fewer do, it looks random, and one
    of them has at least ``main_share`` of the documents with it; else ``shared``.
    """
    found = stage(candidates(docs).withColumn("secret_hash", F.sha2("secret", 256)), "secret-candidates")
    owned = stage(ownership(found), "secret-owners")
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    random = (F.size(F.array_distinct(F.split("secret", ""))) >= 8) & F.col("secret").rlike("[0-9]")
    main = F.col("n_most") >= main_share * F.col("n_documents")
    verdict = F.when(F.col("n_owners") >= example_owners, "example").when(main & random, "live").otherwise("shared")
    rows = found.join(owned, "secret_hash").withColumn("verdict", verdict)
    rows = rows.filter((F.col("kind") != "owned") | (F.col("verdict") == "live"))
    # A wide span is free if no base span that starts before it reaches into it, and none that starts later starts inside.
    own = Window.partitionBy(*_KEY).orderBy("start")
    base = F.col("kind") != "owned"
    reached = F.max(F.when(base, F.col("stop"))).over(own.rangeBetween(Window.unboundedPreceding, 0))
    following = F.min(F.when(base, F.col("start"))).over(own.rangeBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("reached", reached).withColumn("following", following)
    covered = (F.col("reached") > F.col("start")) | (F.col("following") < F.col("stop"))
    rows = rows.filter(base | ~F.coalesce(covered, F.lit(False)))
    span = F.struct("start", order.alias("rank"), "stop", "kind", "verdict", "n_owners", "n_documents")
    return rows.groupBy(*_KEY).agg(F.sort_array(F.collect_set(span)).alias("spans"))


def with_spans(docs: DataFrame, example_owners: int = 3) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, spans (empty where there are none)."""
    found = find_secrets(docs, example_owners)
    found = found.select(F.col("doc_id").alias("id_s"), F.col("text_hash").alias("hash_s"), "spans")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"))
    same = rows["doc_id"].eqNullSafe(found["id_s"]) & (rows["text_hash"] == found["hash_s"])
    kind = "array<struct<start:bigint,rank:bigint,stop:bigint,kind:string,verdict:string,n_owners:bigint,n_documents:bigint>>"
    return rows.join(found, same, "left").select("doc_id", "text_hash", F.coalesce("spans", F.array().cast(kind)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, in order, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def verdicts(spans: Column) -> Column:
    """verdict:owners:documents of each span, in order, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["verdict"], x["n_owners"], x["n_documents"])), ",")


def redacted(text: Column, spans: Column, mark: str = "<secret>") -> Column:
    """The text with its spans replaced by a mark, overlapping ones by one mark."""
    state = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(a: Column, x: Column) -> Column:
        before = F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), F.lit(mark))
        return F.struct(
            F.when(x["start"] >= a["at"], before).otherwise(a["out"]).alias("out"), F.greatest(a["at"], x["stop"]).alias("at")
        )

    end = lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, state, step, end)).otherwise(text)


def redact(docs: DataFrame, example_owners: int = 3) -> DataFrame:
    """``docs`` with live and shared secrets replaced; examples stay. n_chars, if there, follows the text."""
    found = find_secrets(docs, example_owners)
    own = [fresh(x, docs.columns) for x in ("secret_doc", "secret_text", "secret_spans")]
    spans = F.filter("spans", lambda x: x["verdict"] != "example")
    found = found.select(F.col("doc_id").alias(own[0]), F.col("text_hash").alias(own[1]), spans.alias(own[2]))
    found = found.filter(F.size(own[2]) > 0)
    same = docs["doc_id"].eqNullSafe(found[own[0]]) & (F.xxhash64(docs["text"]) == found[own[1]])
    rows = docs.join(found, same, "left")
    hit = F.col(own[2]).isNotNull()
    text = F.when(hit, redacted(F.col("text"), F.col(own[2]))).otherwise(F.col("text"))
    rows = rows.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns], hit.alias(own[2]))
    size = F.when(F.col(own[2]), F.length("text").cast("bigint")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return rows.select(*[size.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])
