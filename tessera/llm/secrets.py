"""Secret scans over a trigram inverted index, with DataFrame operations only.

From each rule's regex a Boolean query over trigrams of the lower-cased text is derived: literal parts that every match must
hold give groups of alternatives, each of which is a set of trigrams. One pass writes the postings of the trigrams that any
query names, keyed by document; the queries are answered by joining the postings with the queries' trigrams and counting; and
each rule's regex is then run on the documents that its query leaves. A rule without mandatory trigrams scans all documents.

Matches are leftmost and do not overlap within a kind; offsets are code points, end exclusive.

Defined results: a null text is empty and has no spans; rows that share id and text share a verdict, rows that share only the
id are scanned one by one; a null id is scanned like any other; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, documents, text_column

#: Most strings that a literal part is spelled out into.
SPELLED = 12


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0  # characters that the group must have


#: Fixed by the contract.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Published formats of keys.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_live_[0-9a-zA-Z]{20,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

Query = list[set[frozenset[str]]]


def spell(op, arg) -> set[str] | None:
    """All strings, lower-cased, that a part of a pattern matches, or None if they are too many."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN:
        if any(kind is not sre.LITERAL for kind, _ in arg):
            return None
        return {chr(c).lower() for _, c in arg} if len(arg) <= SPELLED else None
    if op is sre.SUBPATTERN:
        return spell_all(arg[-1])
    if op is sre.BRANCH:
        parts = [spell_all(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op is sre.MAX_REPEAT and arg[1] <= 4:
        part = spell_all(arg[2])
        if part is None or len(part) ** arg[1] > SPELLED:
            return None
        return {"".join(x) for n in range(arg[0], arg[1] + 1) for x in product(part, repeat=n)}
    return None


def spell_all(items) -> set[str] | None:
    out = {""}
    for op, arg in items:
        part = spell(op, arg)
        if part is None or len(out) * len(part) > SPELLED:
            return None
        out = {a + b for a in out for b in part}
    return out


def mandatory(items) -> Query:
    """Groups of which each match holds, for every group, all trigrams of one alternative."""
    out: Query = []
    now = {""}

    def settle() -> None:
        if all(len(x) >= 3 for x in now):
            out.append({frozenset(x[i : i + 3] for i in range(len(x) - 2)) for x in now})

    for op, arg in items:
        part = spell(op, arg)
        if part is not None and len(now) * len(part) <= SPELLED:
            now = {a + b for a in now for b in part}
            continue
        settle()
        now = part if part is not None and len(part) <= SPELLED else {""}
        if part is None and op is sre.SUBPATTERN:
            out += mandatory(arg[-1])
        elif part is None and op is sre.MAX_REPEAT and arg[0] > 0:
            out += mandatory(arg[2])
    settle()
    return out


def trigram_query(pattern: str) -> Query:
    return mandatory(parser.parse(pattern))


def candidates(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id, h and the kinds whose trigram query the text answers. texts: doc_id, text, h."""
    spark = texts.sparkSession
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    wanted = [(kind, g, a, t, len(alt), len(q)) for kind, q in queries.items() for g, alts in enumerate(q) for a, alt in enumerate(sorted(alts, key=sorted)) for t in sorted(alt)]
    names = sorted({w[3] for w in wanted})
    folded = texts.select("doc_id", "h", F.lower("text").alias("folded"))
    postings = folded.select("doc_id", "h", F.explode(F.array_compact(F.array(*(F.when(F.contains("folded", F.lit(t)), F.lit(t)) for t in names)))).alias("trigram")).distinct()
    terms = spark.createDataFrame(wanted, "kind string, part int, choice int, trigram string, trigrams long, parts long")
    met = postings.join(F.broadcast(terms), "trigram").groupBy("doc_id", "h", "kind", "part", "choice", "trigrams", "parts").agg(F.count("*").alias("n")).where("n = trigrams")
    kinds = met.groupBy("doc_id", "h", "kind", "parts").agg(F.count_distinct("part").alias("n")).where("n = parts")
    return kinds.groupBy("doc_id", "h").agg(F.collect_set("kind").alias("kinds"))


def spans(text: Column, rule: Rule, place: int) -> Column:
    """array<struct<start, place, kind, end>> of a rule's matches: what lies between matches tells where they are."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    zipped = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), found.alias("match"), tested.alias("tested"))
    none = F.array().cast("array<struct<start:long,place:int,kind:string,end:long>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.coalesce(F.char_length(x["match"]), F.lit(0))
        one = F.struct(start.cast("long").alias("start"), F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"), end.cast("long").alias("end"))
        take = x["match"].isNotNull() & (F.char_length(x["tested"]) >= rule.least)
        return F.struct(end.cast("long").alias("at"), F.when(take, F.array_append(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))
    return F.when(text.rlike(rule.pattern), F.aggregate(zipped, start, step, lambda acc: acc["out"])).otherwise(none)


def scan(docs: DataFrame, more: tuple[Rule, ...] = MORE, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the kept columns, text and spans of each row."""
    rules = (*BASE, *more)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, text_column().alias("text")).withColumn("h", F.xxhash64("text"))
    found = cut(candidates(texts.select("doc_id", "text", "h"), rules)).select(F.col("doc_id").alias("id"), F.col("h").alias("hash"), "kinds")
    both = texts.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("hash")), "left")
    return both.select("doc_id", *keep, "text", all_spans(F.col("text"), F.col("kinds"), rules).alias("spans"))


def all_spans(text: Column, kinds: Column, rules: tuple[Rule, ...]) -> Column:
    """The spans of all rules, in order; a rule with a trigram query only runs where the index leaves it."""
    none = F.array().cast("array<struct<start:long,place:int,kind:string,end:long>>")
    each = [F.when(F.array_contains(kinds, r.kind), spans(text, r, i)).otherwise(none) if trigram_query(r.pattern) else spans(text, r, i) for i, r in enumerate(rules)]
    return F.array_sort(F.concat(*each))


def listed(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, found: Column, mask: str = "[secret]") -> Column:
    """The text with each run of overlapping or touching spans replaced."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        new = (x["start"] > acc["at"]) | (acc["at"] == 0)
        out = F.when(new, F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text)))
    return F.when(F.size(found) > 0, F.aggregate(found, zero, step, rest)).otherwise(text)


def mask(docs: DataFrame, more: tuple[Rule, ...] = MORE, by: str = "[secret]") -> DataFrame:
    """docs with the secrets masked in the text, and n_chars, if there, as the text's new length where it changed; all else as it is."""
    rules = (*BASE, *more)
    marked = docs.withColumn("__text", text_column()).withColumn("__h", F.xxhash64("__text"))
    found = cut(candidates(marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__text").alias("text"), F.col("__h").alias("h")), rules))
    found = found.select(F.col("doc_id").alias("__id"), F.col("h").alias("__hash"), F.col("kinds").alias("__kinds"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash"))
    both = marked.join(found, same, "left").withColumn("__spans", all_spans(F.col("__text"), F.col("__kinds"), rules))
    hit = F.size("__spans") > 0
    out = both.withColumn("text", F.when(hit, redacted(F.col("__text"), F.col("__spans"), by)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document."""
    found = scan(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["place"] < len(BASE))
    return found.select(
        "doc_id",
        *(count(r.kind).alias(f"n_{r.kind}") for r in BASE),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
