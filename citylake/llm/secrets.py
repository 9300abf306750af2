"""Secret scans over an incremental ledger of blobs, in DataFrame and SQL functions alone."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citylake.llm.common import as_row, of_row, stored


@dataclass(frozen=True)
class Rule:
    """One kind of secret. A match counts if ``group`` of it has ``least`` characters; ``hint`` is a fixed
    string in every match, or None. A change of the pattern asks for a new version."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    hint: str | None = None

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The three base kinds, in the order in which ties are listed.
BASE = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16, "AKIA"),
    Rule("hex", 1, r"[0-9a-f]{32,}+", 0, 32),
)
#: Kinds that the ledger's rule set adds to the base.
ADDED = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hint="PRIVATE KEY-----"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}+", hint="gh"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", hint="eyJ"),
)
RULES = BASE + ADDED
SPAN = "struct<kind:string,start:int,`end`:int>"


def _literal(text: str) -> str:
    """A SQL string of a pattern; both quotes are written as escapes of the pattern."""
    return "'" + text.replace("'", "\\x27").replace('"', "\\x22").replace("\\", "\\\\") + "'"


def _matches(text: str, rule: Rule) -> Column:
    """Spans of a rule's leftmost matches that do not overlap, in code points. What lies between the matches
    comes from split, the matches from regexp_extract_all; adding up their lengths gives the places."""
    p = _literal(rule.pattern)
    hits = f"regexp_extract_all({text}, {p}, 0)"
    judged = hits if rule.group == 0 else f"regexp_extract_all({text}, {p}, {rule.group})"
    walked = f"""aggregate(
        arrays_zip(split({text}, {p}, -1), {hits}, {judged}),
        struct(0 as at, cast(array() as array<{SPAN}>) as found),
        (a, x) -> struct(
            cast(a.at + length(x.`0`) + coalesce(length(x.`1`), 0) as int) as at,
            case when length(x.`2`) >= {rule.least}
                then array_append(a.found, struct('{rule.kind}' as kind, cast(a.at + length(x.`0`) as int) as start,
                                                  cast(a.at + length(x.`0`) + length(x.`1`) as int) as `end`))
                else a.found end as found),
        a -> a.found)"""
    test = f"{text} rlike {p}" if rule.hint is None else f"contains({text}, '{rule.hint}') and {text} rlike {p}"
    return F.expr(f"case when {test} then {walked} else cast(array() as array<{SPAN}>) end")


def blobs(docs: DataFrame, content: str = "text") -> DataFrame:
    """(blob, content): each different content once, under its address, the SHA-256 of its UTF-8 bytes. Null
    is the empty content. Copies are combined before they move, so a content that most rows share is one
    row from each task."""
    text = F.coalesce(F.col(content).cast("string"), F.lit(""))
    return docs.select(F.sha2(text, 256).alias("blob"), text.alias("content")).groupBy("blob").agg(F.first("content").alias("content"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES, content: str = "text") -> DataFrame:
    """New ledger rows: (blob, rule, spans) of every pair of a content in ``docs`` and a rule version that the
    ledger does not list. spans holds kind, start and end (code points, end exclusive) and may be empty.

    Only contents with an unlisted pair are scanned, each once and only by the rules it lacks. Append the
    result to the ledger's table; docs may hold any number of versions of a path. Empty docs give no rows.
    """
    known = F.lit(None).cast("array<string>").alias("known")
    addressed = blobs(docs, content)
    if ledger is None:
        fresh = addressed.select("blob", "content", known)
    else:
        listed = ledger.groupBy("blob").agg(F.collect_set("rule").alias("known"))  # at most one entry a rule
        every = F.array(*[F.lit(r.key) for r in rules])
        fresh = addressed.join(listed, "blob", "left").where(F.size(F.array_except(every, F.coalesce("known", F.array().cast("array<string>")))) > 0)
    pairs = [
        F.when(
            ~F.coalesce(F.array_contains("known", r.key), F.lit(False)),
            F.struct(F.lit(r.key).alias("rule"), _matches("content", r).alias("spans")),
        )
        for r in rules
    ]
    scanned = fresh.select("blob", F.filter(F.array(*pairs), lambda p: p.isNotNull()).alias("pairs"))
    return scanned.select("blob", F.inline("pairs"))


def findings(docs: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES, content: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``spans``: what the ledger has on each row's content by these rules, by start
    and then by the order of the rules. Rows without findings have an empty array. A column of docs that is
    named spans is replaced. Repeated rows and null ids are kept."""
    order = {r.kind: k for k, r in enumerate(rules)}
    rank = F.create_map(*[F.lit(x) for item in order.items() for x in item])
    hits = ledger.where(F.col("rule").isin([r.key for r in rules]) & (F.size("spans") > 0)).dropDuplicates(["blob", "rule"])
    hits = hits.select("blob", F.explode("spans").alias("x")).groupBy("blob").agg(
        F.sort_array(F.collect_list(F.struct(F.col("x.start").alias("start"), rank[F.col("x.kind")].alias("rank"), F.col("x.end").alias("end"), F.col("x.kind").alias("kind")))).alias("found")
    )
    own = F.sha2(F.coalesce(F.col(content).cast("string"), F.lit("")), 256)
    hits = stored(hits, "findings")  # a table of its own: Spark can then split a content that very many rows have
    spans = F.transform("found", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    joined = docs.select(as_row(docs), own.alias("own")).join(hits, F.col("own") == F.col("blob"), "left")
    return joined.select(*of_row(docs, ["spans"]), F.coalesce(spans, F.array().cast(f"array<{SPAN}>")).alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end of an array of spans, comma-joined."""
    one = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redacted(content: str = "text", spans: str = "spans", mark: str = "[SECRET]") -> Column:
    """The content with every span, or chain of overlapping spans, replaced by the mark."""
    return F.expr(
        f"""case when size({spans}) = 0 then {content} else aggregate({spans},
            struct(cast(0 as int) as at, cast('' as string) as out),
            (a, x) -> case when x.`end` <= a.at then a
                when x.start < a.at then struct(x.`end` as at, a.out as out)
                else struct(x.`end` as at, concat(a.out, substring({content}, a.at + 1, x.start - a.at), '{mark}') as out) end,
            a -> concat(a.out, substring({content}, a.at + 1))) end"""
    )
