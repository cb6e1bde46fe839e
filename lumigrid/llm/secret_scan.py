"""Secret scans over a trigram inverted index.

Each rule's regular expression is turned into a Boolean trigram query (an OR of ANDs) from the literals that every
match must hold. The index has one posting (trigram, doc_id) for each trigram that some rule asks for; postings are
intersected per conjunction, and only the candidates so found are verified with the rule's expression. A rule without
mandatory trigrams is verified on every text.

Everything is a DataFrame expression. Candidates are written as a small table first, so that Catalyst knows its size:
it is broadcast under spark.sql.autoBroadcastJoinThreshold and shuffle-joined beyond it.

Defined results: a null text is empty; an empty text has no spans; repeated ids and rows each keep a row of their
own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re._constants as sre
import re._parser as sre_parse
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumigrid.llm import common, spans


@dataclass(frozen=True)
class Rule:
    """kind; a pattern that Java and Python read alike; the group whose code points are counted, and how many it needs."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules, in the order in which kinds of one start are listed.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Further public credential formats.
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", 0, 1),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("map_key", r"AIza[0-9A-Za-z_-]+", 0, 39),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
)
RULES = BASE + MORE

#: At most this many alternative literals are followed while a query is derived; beyond, the literal is cut there.
MAX_FORKS = 64


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """The pattern as an OR of ANDs of lower-case trigrams that each match must hold; [] means every text qualifies."""
    found: list[list[frozenset[str]]] = []  # each entry: alternatives, one of which must hold

    def flush(heads: set[str]) -> None:
        ways = [frozenset(h[i : i + 3] for i in range(len(h) - 2)) for h in heads]
        if ways and all(ways):
            found.append(ways)

    def literals(items) -> set[str] | None:
        """All strings that a sequence can match, if these are few."""
        out = {""}
        for op, arg in items:
            if op is sre.LITERAL:
                ends = {chr(arg).lower()}
            elif op is sre.SUBPATTERN:
                ends = literals(arg[3])
            elif op is sre.BRANCH:
                parts = [literals(x) for x in arg[1]]
                ends = None if None in parts else set().union(*parts)
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] != sre.MAXREPEAT and arg[1] <= 2:
                one = literals(arg[2])
                ends = None if one is None else {"".join(x) for n in range(arg[0], arg[1] + 1) for x in itertools.product(one, repeat=n)}
            elif op is sre.IN and all(k is sre.LITERAL for k, _ in arg) and len(arg) <= 8:
                ends = {chr(v).lower() for _, v in arg}
            else:
                ends = None
            if ends is None or len(out) * len(ends) > MAX_FORKS:
                return None
            out = {a + b for a in out for b in ends}
        return out

    def walk(items) -> None:
        heads = {""}
        for item in items:
            ends = literals([item])
            if ends is not None and len(heads) * len(ends) <= MAX_FORKS:
                heads = {a + b for a in heads for b in ends}
                continue
            flush(heads)
            heads = {""}
            op, arg = item
            if op is sre.SUBPATTERN:
                walk(arg[3])
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                walk(arg[2])
        flush(heads)

    walk(sre_parse.parse(pattern))
    if not found:
        return []
    best = max(found, key=lambda ways: min(map(len, ways)))
    rest = [ways[0] for ways in found if len(ways) == 1 and ways is not best]
    ways = {frozenset().union(way, *rest) for way in best}
    return sorted((w for w in ways if not any(v < w for v in ways)), key=sorted)  # a way that holds another one says no more


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id) of the asked trigrams over lower-cased texts."""
    low = docs.select("doc_id", F.lower("text").alias("low"))
    held = F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams])
    return low.select("doc_id", F.explode(F.array_compact(held)).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, rules array<string>): for each document the rules one of whose conjunctions it holds in full."""
    held = index.groupBy("doc_id").agg(F.collect_set("trigram").alias("held"))

    def qualifies(rule: Rule) -> Column:
        ways = [F.size(F.array_except(F.array(*map(F.lit, sorted(way))), "held")) == 0 for way in trigram_query(rule.pattern)]
        return F.when(_any(ways), F.lit(rule.kind))

    asked = F.array_compact(F.array(*[qualifies(r) for r in rules if trigram_query(r.pattern)]))
    return held.select("doc_id", asked.alias("rules")).where(F.size("rules") > 0)


def _any(ways: list[Column]) -> Column:
    out = ways[0]
    for w in ways[1:]:
        out = out | w
    return out


def spanned(base: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """base (doc_id, text and what else it has) with spans array<struct<start, order, kind, end>>."""
    indexed = [r for r in rules if trigram_query(r.pattern)]
    trigrams = sorted({t for r in indexed for way in trigram_query(r.pattern) for t in way})
    if trigrams:
        chosen = common.written(candidates(build_index(base, trigrams), rules), "secret-candidates")
        chosen = chosen.select(F.col("doc_id").alias("__id"), F.col("rules").alias("__rules"))
        base = base.join(chosen, F.col("doc_id").eqNullSafe(F.col("__id")), "left").drop("__id")
    none = F.array().cast("array<struct<start:bigint,order:int,kind:string,end:bigint>>")
    parts = []
    for order, r in enumerate(rules):
        hits = spans.placed(F.col("text"), r.pattern, r.group, r.least, order, r.kind)
        likely = F.coalesce(F.array_contains("__rules", r.kind), F.lit(False)) if r in indexed else F.rlike("text", F.lit(r.pattern))
        parts.append(F.when(likely, hits).otherwise(none))
    return base.withColumn("spans", F.array_sort(F.concat(*parts))).drop("__rules")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, text, spans), a row for each row of docs (doc_id, text)."""
    return spanned(common.corpus(docs), rules)


def listed(column: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """A row for each document: counts and the hash of the base spans, and all spans."""
    base = F.filter("spans", lambda x: x["order"] < len(BASE))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs).select("doc_id", *[count(r.kind) for r in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mask: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs, all columns kept, with each span of a rule in its text replaced by the mask. Spans that overlap are
    replaced together by one mask. A null text stays null."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.struct(*docs.columns).alias("row"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.col("text").substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    tail = lambda acc: F.concat(acc["out"], F.col("text").substr((acc["at"] + 1).cast("int"), F.lit(2**31 - 1)))
    clean = F.when(F.size("spans") > 0, F.aggregate("spans", start, step, tail)).otherwise(F.col("row.text"))
    return spanned(base, rules).select(*[clean.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
