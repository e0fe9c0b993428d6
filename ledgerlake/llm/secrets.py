"""Secret scans over an incremental blob ledger, in DataFrame operations alone.

A text is a version of a blob, named by its SHA-256. A ledger holds, for each blob and rule version scanned so far, the
spans found, none included. A scan takes each distinct blob once, applies the rule versions that the ledger lacks for it,
and joins all findings back to every path (document) that has the blob.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written


@dataclass(frozen=True)
class Rule:
    """pattern's matches, leftmost first and not overlapping, whose group has at least ``least`` characters.

    A blob without any of ``hints`` (lower case where ``fold``) is passed over; without hints every blob is tried.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    hints: tuple[str, ...] = ()
    fold: bool = False
    version: int = 1


def _either(word: str) -> str:
    """Letters in either case, as classes, which every regex engine reads alike."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key")))
#: The base rules first, in the order of their kinds; then what this scan adds.
BASE = (
    Rule("assign", rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, ("password", "passwd", "secret", "token", "apikey", "api_key"), True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, ("AKIA",)),
    Rule("hex", r"[0-9a-f]{24,}"),  # the same spans as [0-9a-f]+ and a check of 24 characters, in fewer matches
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hints=("PRIVATE KEY-----",)),
    Rule("forge", r"gh[opsur]_[A-Za-z0-9]+", 0, 40, ("ghp_", "gho_", "ghs_", "ghu_", "ghr_")),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20, ("xox",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hints=("eyJ",)),
)
RULES = BASE + ADDED
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


#: Elements of an array that are folded together. Appending copies what is there, so a fold over many elements goes by parts.
AT_ONCE = 500


def _fold(items: Column, state: Column, out: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """(state, out) after all items: step(state, item) gives the next state and what to append, an array, to out."""
    none = F.array().cast(f"array<{out}>")
    pair = lambda state, out: F.struct(state.alias("state"), out.alias("out"))
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(AT_ONCE)), lambda k: F.slice(items, k + 1, F.lit(AT_ONCE)))

    def one(acc: Column, x: Column) -> Column:
        then, more = step(acc["state"], x)
        return pair(then, F.concat(acc["out"], more))

    def part(acc: Column, some: Column) -> Column:
        folded = F.array(F.aggregate(some, pair(acc["state"], none), one))  # an array of one, so that it is folded once
        return F.transform(folded, lambda f: pair(f["state"], F.array_append(acc["out"], f["out"])))[0]

    whole = F.aggregate(parts, pair(state, F.array().cast(f"array<array<{out}>>")), part)
    return F.transform(F.array(whole), lambda w: pair(w["state"], F.flatten(w["out"])))[0]


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans in code points. The pieces between matches and the matches themselves give every start by their lengths."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    pieces = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(matches))
    steps = F.arrays_zip(pieces.alias("piece"), matches.alias("match"), groups.alias("held"))

    none = F.array().cast(SPAN)

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["piece"])
        end = start + F.length(x["match"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return end, F.when(F.length(x["held"]) >= rule.least, F.array(span)).otherwise(none)

    found = _fold(steps, F.lit(0), "struct<start:int,rank:int,end:int,kind:string>", step)["out"]
    if rule.hints:
        seen = F.lower(text) if rule.fold else text
        hinted = F.lit(False)
        for h in rule.hints:
            hinted = hinted | seen.contains(h)
        return F.when(hinted & text.rlike(rule.pattern), found).otherwise(none)
    return F.when(text.rlike(rule.pattern), found).otherwise(none)


def _scanned(docs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """A written table with a row for each distinct text: blob, the ledger's spans before, and a column of spans for each
    rule, null where the ledger had it."""
    none, nothing = F.array().cast(SPAN), F.array().cast("array<string>")
    known = None
    if ledger is None:
        blobs = docs.groupBy("blob").agg(F.first("text").alias("text")).withColumns({"done": nothing, "before": none})
    else:
        versions = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)])
        current = ledger.where(F.coalesce(F.element_at(versions, F.col("kind")) == F.col("version"), F.lit(False)))
        current = current.groupBy("blob").agg(F.collect_set("kind").alias("done"), F.flatten(F.collect_list("spans")).alias("before"))
        # digests meet the ledger first; only texts that some rule has not seen are moved, where Spark's size check allows by
        # sending those digests to the texts
        here = docs.select("blob").distinct().join(current, "blob", "left").withColumns({"done": F.coalesce("done", nothing), "before": F.coalesce("before", none)})
        here = written(here, "ledger-state")
        unseen = here.where(F.size("done") < len(rules))
        known = here.where(F.size("done") >= len(rules)).select("blob", "before", *[F.lit(None).cast(SPAN).alias(r.kind) for r in rules])
        texts = docs.join(unseen.select("blob"), "blob", "left_semi").groupBy("blob").agg(F.first("text").alias("text"))
        blobs = texts.join(unseen, "blob")
    found = [F.when(~F.array_contains("done", r.kind), _spans(F.col("text"), r, k)).alias(r.kind) for k, r in enumerate(rules)]
    scanned = blobs.select("blob", "before", *found)
    # written, so that a rerun finds what was scanned, and joins with it deal both of their sides anew and can split a hot blob
    return written(scanned if known is None else scanned.unionByName(known), "scanned")


def _hits(scanned: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    none = F.array().cast(SPAN)
    spans = F.sort_array(F.concat("before", *[F.coalesce(r.kind, none) for r in rules]))
    return scanned.select("blob", spans.alias("spans")).where(F.size("spans") > 0)


def _blob(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings, entries) of docs (doc_id, text).

    findings: doc_id, blob, spans (array of start, rank, end, kind in order of start, then rule) for every row, the ledger's
    earlier findings included. entries: (blob, kind, version, spans) of the pairs scanned now; append them to the ledger.
    Null texts count as empty. A blob's text is aggregated in the map tasks first, so copies of one text, however many, send
    one row a task. Rows of equal doc_id are paths of their own. An empty table gives no rows.
    """
    paths = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", _blob(F.col("text")))
    scanned = _scanned(paths, ledger, rules)
    each = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.col(r.kind).alias("spans")) for r in rules])
    entries = scanned.select("blob", F.explode(each).alias("e")).select("blob", "e.kind", "e.version", "e.spans").where("spans IS NOT NULL")
    found = paths.select("doc_id", "blob").join(_hits(scanned, rules), "blob", "left")
    return found.select("doc_id", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans")), entries


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs, all columns, with each secret in text replaced by <SECRET:kind> and n_chars, where there is one, brought up to date.

    Each distinct text is scanned once, as in scan; only texts with findings are rewritten. Of overlapping spans the
    earliest, then the first rule's, is replaced; what others cover beyond it goes with it. Null texts stay null.
    """
    text = F.col("text")
    scanned = _scanned(docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", _blob(text)), None, rules)
    # no column of docs can have these names
    blob, spans = ("_".join([name, *docs.columns]) for name in ("blob", "spans"))
    hits = _hits(scanned, rules).select(F.col("blob").alias(blob), F.col("spans").alias(spans))

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        mark = F.concat(F.substr(text, at + 1, F.greatest(s["start"] - at, F.lit(0))), F.lit("<SECRET:"), s["kind"], F.lit(">"))
        return F.greatest(at, s["end"]), F.when(s["start"] < at, F.array().cast("array<string>")).otherwise(F.array(mark))

    folded = F.transform(F.array(_fold(F.col(spans), F.lit(0), "string", step)), lambda f: F.concat(F.array_join(f["out"], ""), F.substr(text, f["state"] + 1, F.length(text))))
    clean = folded[0]
    hit = F.col(spans).isNotNull()
    joined = docs.withColumn(blob, _blob(text)).join(hits, blob, "left")
    fixed = joined.withColumn("text", F.when(hit, clean).otherwise(text))
    if "n_chars" in docs.columns:
        fixed = fixed.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return fixed.select(*docs.columns)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; an empty ledger, so every blob is scanned once with every rule."""
    found, _ = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def op5_sql() -> str:
    """The scan in DuckDB's SQL, without the ledger."""
    parts = []
    for rank, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, '{p}', 0) AS ms, "
            f"regexp_extract_all(t, '{p}', {r.group}) AS gs, regexp_split_to_array(t, '{p}') AS ps FROM d"
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
e AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m),
s AS (
  SELECT doc_id, rank, kind, length(ms[i]) AS n,
    list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS start
  FROM e WHERE length(gs[i]) >= least
), o AS (
  SELECT doc_id, rank, start, kind || ':' || CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(start + n AS BIGINT) AS VARCHAR) AS span FROM s
), g AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS b, count(*) FILTER (rank = 2) AS c,
    string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans
  FROM o GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(b, 0) AS BIGINT) AS n_access, CAST(coalesce(c, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""
