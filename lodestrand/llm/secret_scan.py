"""Secret scans with a trigram inverted index, with DataFrame operations only.

Each rule's regular expression is parsed and turned into a Boolean trigram query: an OR of ANDs of trigrams
that every match must contain.  The index holds, for each trigram that some query names, the documents that
contain it (in lower case); it is a table, which further scans of the same documents may be given.  Postings are
intersected per conjunct, and only the candidates are verified with the regular expression.  A rule without
mandatory trigrams scans every text.

The base rules are those of the contract; the others add spans of keys and tokens in well-known formats.

Defined cases: a null text is empty and has no spans; rows that repeat a doc_id are told apart by their text's
hash, equal rows have equal results; positions are code points of the whole text, end exclusive; a text of any
length is scanned whole; other columns are carried along by ``scan`` and replaced where named like an added
one; no rows, no result.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.arrays import cuts, let, running_before, sums_before
from lodestrand.llm.scratch import NO_ID, table, without

_parser = re._parser  # the tree of a regular expression
_MANY = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, the group that is measured and the least length of that group."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The rules of the base contract, in their order.  A maximal run of a character class that has
#: the least length is written as a bounded repeat, which finds the same runs.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Published formats of keys and tokens.
ADDED = (
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]{1,16} ){0,3}PRIVATE KEY-----"),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay_key", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D:/@]{1,64}:[^\x20\x09-\x0D:/@]{1,64}@"),
)
RULES = BASE + ADDED


def literals(pattern: str) -> list[set[str]]:
    """Mandatory literal strings of a pattern as a conjunction of alternatives, in lower case."""

    def of(nodes) -> tuple[list[set[str]], set[str] | None]:
        """(what must occur, all strings this can match exactly or None)."""
        must: list[set[str]] = []
        run: set[str] | None = {""}
        for op, arg in nodes:
            name = str(op)
            exact: set[str] | None = None
            inner: list[set[str]] = []
            if name == "LITERAL":
                exact = {chr(arg).lower()}
            elif name == "IN" and all(str(k) == "LITERAL" for k, _ in arg):
                exact = {chr(c).lower() for _, c in arg}
            elif name == "SUBPATTERN":
                inner, exact = of(arg[3])
            elif name == "BRANCH":
                each = [of(x) for x in arg[1]]
                if all(e is not None for _, e in each):
                    exact = set().union(*[e for _, e in each])
                elif all(m for m, _ in each):
                    inner = [set().union(*[max(m, key=lambda s: min(map(len, s))) for m, _ in each])]
            elif name == "MAX_REPEAT":
                low, high, sub = arg
                sub_must, sub_exact = of(sub)
                if low == 0 and high == 1 and sub_exact is not None:
                    exact = sub_exact | {""}
                elif low >= 1:
                    inner = sub_must + ([sub_exact] if sub_exact else [])
            elif name == "AT":
                continue
            if exact is not None and run is not None and len(run) * len(exact) <= _MANY:
                run = {a + b for a in run for b in exact}
                continue
            if run and run != {""}:
                must.append(run)
            must += inner
            run = exact
        if must or run is None:
            return must + ([run] if run and run != {""} else []), None
        return [run], run

    return [s for s in of(_parser.parse(pattern))[0] if all(len(x) >= 3 for x in s)]


def trigram_query(pattern: str) -> list[list[str]]:
    """OR of ANDs: one list of trigrams for each alternative of the most selective literal; [] if none is mandatory."""
    found = literals(pattern)
    if not found:
        return []
    best = max(found, key=lambda s: min(map(len, s)))
    return [list(q) for q in sorted({tuple(sorted({x[i : i + 3] for i in range(len(x) - 2)})) for x in best})]


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """(gram, d, f): the documents that contain each of the given trigrams."""
    low = docs.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long").alias("d"), F.xxhash64("text").alias("f"), F.lower(_text()).alias("low"))
    if not grams:
        return low.select("d", "f", F.lit("").alias("gram")).limit(0)
    there = F.filter(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]), lambda g: g.isNotNull())
    return low.select("d", "f", F.explode(there).alias("gram"))


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The written postings of every trigram that the rules' queries name."""
    grams = sorted({g for r in rules for q in trigram_query(r.pattern) for g in q})
    return table(postings(docs, grams), "postings")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(d, f, kinds): the documents that satisfy the trigram query of at least one rule that has one."""
    wants = [(r.kind, i, q) for r in rules for i, q in enumerate(trigram_query(r.pattern))]
    spark = index.sparkSession
    if not wants:
        return spark.createDataFrame([], "d long, f long, kinds array<string>")
    # A row for each trigram of each conjunct of the rules.
    terms = spark.createDataFrame([(k, i, g, len(q)) for k, i, q in wants for g in q], "kind string, conjunct int, gram string, need int")
    met = index.join(F.broadcast(terms), "gram").groupBy("d", "f", "kind", "conjunct", "need").agg(F.count_distinct("gram").alias("have")).where("have = need")
    return met.groupBy("d", "f").agg(F.collect_set("kind").alias("kinds"))


def _spans(rule: Rule) -> Column:
    """array<struct<start, end>> of a rule's matches: lengths of the pieces between matches give the places."""
    pattern = F.lit(rule.pattern)
    hits = F.regexp_extract_all(F.col("_t"), pattern, F.lit(0))
    sizes = F.transform(hits, F.length)
    gaps = F.transform(F.split(F.col("_t"), rule.pattern, -1), F.length)
    held = F.transform(F.regexp_extract_all(F.col("_t"), pattern, F.lit(rule.group)), F.length) if rule.group else sizes
    each = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), sizes.alias("len"), held.alias("held"))

    def placed(m: Column) -> Column:
        before = sums_before(F.transform(m, lambda x: x["gap"] + x["len"]))
        spans = F.zip_with(m, before, lambda x, at: F.struct((at + x["gap"]).cast("int").alias("start"), (at + x["gap"] + x["len"]).cast("int").alias("end"), x["held"].alias("held")))
        return F.transform(F.filter(spans, lambda s: s["held"] >= rule.least), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    return F.when(F.regexp_like("_t", pattern), let(each, placed)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def _labelled(rank: int, kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, index: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``secrets``: array<struct<start, rank, kind, end>>, by start and the order of the rules.

    ``index`` is what ``build_index`` gave for these documents and these or more rules.
    """
    docs = without(docs, "secrets")
    names = docs.columns
    found = table(candidates(build_index(docs, rules) if index is None else index, rules), "secret_candidates")
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("_row"), F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long").alias("d"), F.xxhash64("text").alias("f"))
    rows = rows.join(found, ["d", "f"], "left").withColumn("_t", F.coalesce(F.col("_row.text"), F.lit("")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    parts = []
    for rank, rule in enumerate(rules):
        spans = _spans(rule)
        if trigram_query(rule.pattern):
            spans = F.when(F.array_contains("kinds", rule.kind), spans).otherwise(none)
        parts.append(F.transform(spans, _labelled(rank, rule.kind)))
    return rows.select("_row.*", F.array_sort(reduce(lambda a, b: F.concat(a, b), parts)).alias("secrets"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[secret]") -> DataFrame:
    """``docs`` with each run of overlapping spans replaced by ``mask``; a null text stays null."""
    ends = F.transform("secrets", lambda s: s["end"])
    spans = F.zip_with("secrets", running_before(ends, F.greatest), lambda s, at: F.struct(at.cast("int").alias("start"), s["start"].alias("end")))
    # A span that begins before the greatest end so far belongs to the run before it.
    between = F.filter(spans, lambda s: s["end"] >= s["start"])
    tail = F.struct(F.coalesce(F.array_max(ends), F.lit(0)).alias("start"), F.length("text").alias("end"))
    text = F.array_join(cuts(F.col("text"), F.concat(between, F.array(tail)), lambda _, inside: inside), mask)
    return scan(docs, rules).withColumn("text", F.when(F.col("text").isNotNull(), text)).select(*without(docs, "secrets").columns)
