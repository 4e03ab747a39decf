"""URL filtering: fixed host/path rules first, then association rules over URL tokens.

URLs that the fixed rules decide are the labelled ones (or a table of labelled URLs
is given).  Spark's FP-growth mines token combinations together with the label; rules
whose only consequent is the label are kept when confidence and support are high
enough and no shorter rule says the same as surely.  The kept rules form an inverted
index from each rule's rarest token; a URL looks up its own tokens there and a rule
fits when all its tokens are present.  DataFrame functions only; URLs aren't shuffled,
but for the counts of equal ones when labelled URLs are sampled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Mining:
    """sample: labelled URLs mined at most, in expectation; chosen alike on each run, and equal URLs as often as their share asks for.

    max_items: tokens of a labelled URL that are mined at most, those that tell most about
    its label (see `telling`).  So at most 2 ** (max_items + 1) / min_support combinations
    are supported, however many tokens URLs share.  max_tokens: of a rule.  URLs are
    judged by all their tokens.
    """

    min_support: float = 0.01
    min_confidence: float = 0.9
    max_tokens: int = 3
    max_items: int = 8
    sample: int = 200_000


#: The base rules.
BASE_RULES = (UrlRule("block", "net", "/"), UrlRule("allow", "example.net", "/en/"), UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/"))
#: Fixed rules are compiled into the plan, so their number is bounded.
MAX_FIXED_RULES = 512


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """The longest rule that fits, as struct(rule, verdict), else null."""
    if len(rules) > MAX_FIXED_RULES:
        raise ValueError(f"more than {MAX_FIXED_RULES} fixed rules")
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        chosen = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: host labels and their parts, and words of the path, each with where it stood."""
    def parts(text: Column, by: str, mark: str) -> Column:
        return F.transform(F.filter(F.split(text, by), lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))

    words = F.filter(F.split(F.lower(path), r"[^\p{L}]+"), lambda x: x != "")
    return F.array_distinct(F.concat(parts(host, r"\.", "h:"), parts(host, r"[.-]", "t:"), F.transform(words, lambda x: F.concat(F.lit("p:"), x))))


def telling(labelled: DataFrame, n: int, mining: Mining) -> tuple[Column, Column]:
    """(an expression over tokens and a map column `scores`, that map): the tokens of a labelled (tokens, verdict) that are mined: supported ones, by how surely they have one verdict, then by support and name.

    A token of a rule with enough support has it itself, so others are in no rule.  The
    supported tokens are one map: at most tokens in a URL / min_support of them.
    """
    alone = labelled.select(F.explode("tokens").alias("token"), "verdict").groupBy("token", "verdict").agg(F.count("*").alias("n"))
    known = alone.groupBy("token").agg(F.max("n").alias("most"), F.sum("n").alias("n")).where(F.col("n") >= mining.min_support * n)
    scores = known.agg(F.map_from_entries(F.collect_list(F.struct("token", F.struct((-F.col("most") / F.col("n")).alias("a"), (-F.col("n")).alias("b"))))).alias("scores"))
    looked_up = F.transform("tokens", lambda t: F.struct(F.element_at("scores", t).alias("score"), t.alias("token")))
    best = F.slice(F.array_sort(F.filter(looked_up, lambda x: x["score"].isNotNull())), 1, mining.max_items)
    return F.transform(best, lambda x: x["token"]), scores.select("scores").scalar()


def mine_rules(labelled: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """Rules from labelled (tokens, verdict): items, verdict, confidence, support. Rules are few: each holds for at least a min_support share."""
    labelled = labelled.where(F.col("verdict").isNotNull() & (F.size("tokens") > 0))
    n = labelled.count()
    if n > mining.sample:
        # of rows alike in tokens and verdict their share stays, rounded up or down by a hash
        alike = labelled.groupBy("tokens", "verdict").agg(F.count("*").alias("n"))
        stays = F.floor(F.col("n") * (mining.sample / n) + F.pmod(F.xxhash64("tokens", "verdict"), F.lit(1 << 31)) / (1 << 31))
        labelled = alike.withColumn("stays", stays).where("stays > 0").select("tokens", "verdict", F.explode(F.sequence(F.lit(1), F.col("stays"))))
    tokens_, scores = telling(labelled, labelled.count(), mining)
    items = labelled.withColumn("scores", scores).select(F.concat(tokens_, F.array(F.concat(F.lit("="), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=mining.min_support, minConfidence=mining.min_confidence).fit(items)
    rules = model.associationRules.where(F.col("consequent")[0].startswith("=") & (F.size("antecedent") <= mining.max_tokens))
    rules = rules.select(F.array_sort("antecedent").alias("items"), F.substring(F.col("consequent")[0], 2, 100).alias("verdict"), "confidence", "support")
    rules = rules.where(~F.exists("items", lambda x: x.startswith("=")))
    # pruned: a rule that a shorter one implies at no less confidence
    short = rules.select(F.col("items").alias("s_items"), F.col("verdict").alias("s_verdict"), F.col("confidence").alias("s_conf"), F.explode("items").alias("token"))
    long = rules.withColumn("token", F.explode("items"))
    implied = long.join(short, "token").where((F.size("s_items") < F.size("items")) & (F.col("s_verdict") == F.col("verdict")) & (F.col("s_conf") >= F.col("confidence")) & (F.size(F.array_except("s_items", "items")) == 0))
    return rules.join(implied.select("items", "verdict").distinct(), ["items", "verdict"], "left_anti")


def inverted_index(rules: DataFrame) -> DataFrame:
    """One row: a map from a token to the rules that are filed under it, each under its rarest token among the rules."""
    spread = rules.withColumn("token", F.explode("items"))
    often = spread.groupBy("token").agg(F.count("*").alias("n"))
    filed = spread.join(often, "token").groupBy("items", "verdict", "confidence", "support").agg(F.min(F.struct("n", "token"))["token"].alias("token"))
    entry = F.struct("confidence", "support", "verdict", "items")
    lists = filed.groupBy("token").agg(F.sort_array(F.collect_list(entry)).alias("rules"))
    return lists.agg(F.map_from_entries(F.collect_list(F.struct("token", "rules"))).alias("index"))


def filter_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = BASE_RULES, mining: Mining = Mining(), labels: DataFrame | None = None) -> DataFrame:
    """Judge every row's url: page_id, host, path, rule, verdict, confidence.

    labels: optional (url, verdict) to mine instead of the rows that the fixed rules
    decide.  The surest fitting association rule decides; then the better supported, then
    block; with none, allow.  Null and unparsable URLs have an empty host and path, no
    tokens and are allowed.  Repeated rows each give a row; other columns aren't read; an
    empty table gives an empty result.
    """
    def parsed(df: DataFrame) -> DataFrame:
        host, path = host_and_path(F.col("url"))
        return df.select("*", host.alias("host"), path.alias("path"))

    base = parsed(pages.select("page_id", "url"))
    base = base.select("page_id", "host", "path", fixed_rule(F.col("host"), F.col("path"), rules).alias("fixed"), tokens(F.col("host"), F.col("path")).alias("tokens"))
    if labels is None:
        known = base.select("tokens", F.col("fixed.verdict").alias("verdict"))
    else:
        known = parsed(labels.select("url", "verdict"))
        known = known.select(tokens(F.col("host"), F.col("path")).alias("tokens"), "verdict")
    index = inverted_index(mine_rules(known, mining))
    # a scalar subquery: the index is computed once, and is as small as the supported rules are few
    with_index = base.withColumn("index", F.broadcast(index).select("index").scalar())
    looked_up = F.flatten(F.transform(F.array_intersect("tokens", F.map_keys("index")), lambda t: F.element_at("index", t)))
    fitting = F.filter(looked_up, lambda r: F.size(F.array_except(r["items"], F.col("tokens"))) == 0)
    judged = with_index.select("page_id", "host", "path", "fixed", F.array_max(fitting).alias("mined"))
    verdict = F.coalesce(F.col("fixed.verdict"), F.col("mined.verdict"), F.lit("allow"))
    return judged.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), verdict.alias("verdict"), F.col("mined.confidence").alias("confidence"))
