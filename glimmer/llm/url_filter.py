"""URL filter: explicit host and path rules, and mined association rules for what those leave open.

Labels for mining come from the explicit rules. Every url is a transaction of its tokens, and of the label ``block``
where a rule blocks it; a url that no rule decides counts against a combination as one that is allowed does, so what is
common in urls of all kinds (a top-level domain) gains no confidence from the few that are decided. FP-growth finds
frequent combinations in a bounded sample; their support, confidence and lift are then counted over all urls, and rules
that reach the floors, and no subset of which is as confident, are kept and matched through an inverted index from
token to rules. What they block beyond the explicit rules is at most the share that their confidence leaves open.

Defined results: a null url, or one without ``://``, has an empty host and path, no tokens, no rule and the default
verdict ``allow``; an empty table gives an empty one; repeated rows are judged alike and each counts; of rules that fit
the longest wins, and of equally long ones the last in their list; all tokens of urls of any length count; columns but
page_id and url are ignored, so their names can't clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, table

#: (host, path, verdict); the rules that the query is asked to apply.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
BLOCK = "label=block"


@dataclass(frozen=True)
class MinedRule:
    tokens: frozenset
    support: float
    confidence: float


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return pages.select("*", F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), path.alias("path"))


def explicit_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; both null where none fits.

    A small literal rule list (a parameter, not data): a rule fits its host and all subdomains when the path starts
    with the rule's. Longest is by the written rule, host and path together.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: host labels from the right with their depth, path words, and the file ending."""
    labels = F.reverse(F.split(host, r"\."))
    by_depth = F.transform(F.filter(labels, lambda x: x != ""), lambda x, i: F.concat(F.lit("h"), F.least(i, F.lit(3)).cast("string"), F.lit("="), x))
    words = F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda x: (x != "") & ~x.rlike(r"^\d+$"))
    return F.array_distinct(F.concat(by_depth, F.transform(words, lambda x: F.concat(F.lit("p="), x))))


def mine_rules(seen: DataFrame, min_support: float = 0.002, min_confidence: float = 0.9, min_lift: float = 1.5, most_rows: int = 200_000) -> list[MinedRule]:
    """Block rules from rows (tokens, blocked, order_hash), blocked being true, or else false or null.

    ``most_rows`` bounds the expected sample from which FP-growth proposes rules (chosen by a hash of the row, so alike
    on every run and without a sort), at two thirds of the floors, so that one that holds over all rows is not missed
    for chance. Rules that a rule on one token less equals are dropped by Spark; the others, of which there are few,
    are counted over all rows.
    """
    rows, blocked = seen.agg(F.count(F.lit(1)), F.count_if(F.coalesce("blocked", F.lit(False)))).first()
    if not blocked:
        return []
    drawn = seen.where(F.pmod("order_hash", F.lit(1_000_000)) < int(1_000_000 * min(1.0, most_rows / rows)))
    share = 2 / 3 if rows > most_rows else 1.0
    items = drawn.select(F.when(F.col("blocked"), F.concat("tokens", F.array(F.lit(BLOCK)))).otherwise(F.col("tokens")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support * share, minConfidence=min_confidence * share, numPartitions=16).fit(items)
    found = model.associationRules.where(F.element_at("consequent", 1) == BLOCK).select(F.array_sort("antecedent").alias("tokens"), "confidence")
    found = materialize(found)
    smaller = found.select(F.col("tokens").alias("whole"), "confidence", F.explode("tokens").alias("t")).select("whole", "confidence", F.array_remove("whole", F.col("t")).alias("tokens"))
    beaten = smaller.join(found.withColumnRenamed("confidence", "part"), "tokens").where("part >= confidence").select(F.col("whole").alias("tokens"))
    proposed = [MinedRule(frozenset(r.tokens), 0.0, 0.0) for r in found.join(beaten, "tokens", "left_anti").select("tokens").collect()]
    discard(found)
    kept: list[MinedRule] = []
    counted = [MinedRule(r.tokens, b / rows, b / n) for r, (n, b) in count_rules(seen, proposed).items()]
    for r in sorted(counted, key=lambda r: (len(r.tokens), -r.confidence, sorted(r.tokens))):
        if r.support >= min_support and r.confidence >= max(min_confidence, min_lift * blocked / rows) and not any(k.tokens <= r.tokens and k.confidence >= r.confidence - 1e-12 for k in kept):
            kept.append(r)
    return kept


def count_rules(seen: DataFrame, rules: list[MinedRule]) -> dict[MinedRule, tuple[int, int]]:
    """How many rows hold each rule's tokens, and how many of those are blocked, over all rows."""
    if not rules:
        return {}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = inverted(rules)
        for b in batches:
            n, blocked = Counter(), Counter()
            for tokens, bad in zip(b.tokens, b.blocked):
                for k in fitting(index, rules, tokens):
                    n[k] += 1
                    blocked[k] += bool(bad)
            yield pd.DataFrame({"rule": [*n], "n": [*n.values()], "blocked": [blocked[k] for k in n]}).astype("int64")

    found = seen.select("tokens", F.coalesce("blocked", F.lit(False)).alias("blocked")).mapInPandas(count, "rule int, n long, blocked long")
    return {rules[r.rule]: (r.n, r.blocked) for r in found.groupBy("rule").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked")).collect()}


def inverted(rules: list[MinedRule]) -> dict[str, list[int]]:
    """Each rule stands under its rarest token only, so a url looks at few rules."""
    freq = Counter(x for r in rules for x in r.tokens)
    index: dict[str, list[int]] = {}
    for k, r in enumerate(rules):
        index.setdefault(min(r.tokens, key=lambda x: (freq[x], x)), []).append(k)
    return index


def fitting(index: dict[str, list[int]], rules: list[MinedRule], tokens) -> Iterator[int]:
    """The rules all of whose tokens are there."""
    have = set(() if tokens is None else tokens)
    return (k for x in have for k in index.get(x, ()) if rules[k].tokens <= have)


def matcher(rules: list[MinedRule]):
    """Pandas UDF: does any mined rule hold? The rule list is bounded by the support floor."""
    index = inverted(rules)

    @F.pandas_udf("boolean")
    def holds(tokens: pd.Series) -> pd.Series:
        return pd.Series([next(fitting(index, rules, ts), None) is not None for ts in tokens], dtype=bool)

    return holds


def filter_urls(pages: DataFrame, rules=RULES, min_support: float = 0.002, min_confidence: float = 0.9, min_lift: float = 1.5, most_rows: int = 200_000) -> DataFrame:
    """page_id, host, path, rule, verdict, mined (true where a mined rule decided)."""
    seen = with_host_and_path(pages.select(F.col("page_id"), F.col("url")))
    rule, verdict = explicit_rule(F.col("host"), F.col("path"), rules)
    seen = seen.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), url_tokens(F.col("host"), F.col("path")).alias("tokens"))
    labelled = seen.select("tokens", (F.col("by_rule") == "block").alias("blocked"), F.xxhash64("host", "path", "page_id").alias("order_hash"))
    mined = mine_rules(labelled, min_support, min_confidence, min_lift, most_rows)
    holds = matcher(mined)(F.col("tokens")) if mined else F.lit(False)
    return seen.withColumn("held", holds).select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("held"), "block").otherwise("allow")).alias("verdict"), (F.col("by_rule").isNull() & F.col("held")).alias("mined"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
