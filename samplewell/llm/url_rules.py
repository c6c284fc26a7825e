"""URL filter by association rules, in DataFrame functions and Spark's own FP-growth only.

Fixed rules judge the URLs that they fit. The URLs so judged are the labels: FP-growth mines combinations of URL tokens
with each verdict, rules of little support or confidence and rules that a shorter one already implies are pruned, and the
rest judge all other URLs. Tokens of little support are in no rule and are left out before mining; tokens that stand in just the
same labelled URLs are one item, since any of them gives the same rules: otherwise each set of them would be mined. A rule is found
through an inverted index from the rarest of its items; it fires where the URL has a token of each.
"""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplewell.llm.shared import cut, spread_join

#: The verdict, host and path of each rule.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Least share of labelled URLs that have a rule's tokens and verdict, least confidence.
SUPPORT, CONFIDENCE = 0.01, 0.8
#: Up to so many rules (some 10 MB) are broadcast; more are joined by a shuffle.
BROADCAST_RULES = 50_000


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, both empty without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits columns host and path; nulls if none does."""
    name = verdict = None
    for said, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r)):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(path))
        name = F.when(fits, host + path) if name is None else name.when(fits, host + path)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    return name, verdict


def tokens() -> Column:
    """Distinct tokens of columns url, host and path: top-level domain, registered domain, words of further host labels, words of the path with digits folded, its ending, query keys."""
    labels = F.split("host", r"\.")
    further = F.when(F.size(labels) > 2, F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    segments = F.filter(F.split(F.regexp_replace("path", "[0-9]+", "#"), "/"), lambda s: (s != "") & ~s.startswith("#"))
    ending = F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)
    query = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1)), lambda k: k != "")
    return F.array_sort(F.array_distinct(F.concat(
        F.when(F.col("host") != "", F.array(F.concat(F.lit("t:"), F.element_at(labels, -1)), F.concat(F.lit("d:"), F.substring_index("host", ".", -2)))).otherwise(F.array().cast("array<string>")),
        F.transform(F.filter(F.flatten(F.transform(further, lambda x: F.split(x, "[-_]"))), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x)),
        F.transform(segments, lambda s: F.concat(F.lit("p:"), s)),
        F.when(ending != "", F.array(F.concat(F.lit("e:"), ending))).otherwise(F.array().cast("array<string>")),
        F.transform(keys, lambda k: F.concat(F.lit("q:"), k)),
    )))


def _items(labelled: DataFrame, total: int) -> DataFrame:
    """(token, item, n): the tokens of enough labelled rows, the first by name of those that stand in the same rows, and their rows. By SUPPORT, at most 1 / SUPPORT times the mean number of tokens."""
    sets = labelled.groupBy("tokens", "verdict").agg(F.count("*").alias("n"))
    sets = sets.select("n", F.xxhash64("tokens", "verdict").cast("decimal(38,0)").alias("a"), F.xxhash64(F.lit(1), "tokens", "verdict").cast("decimal(38,0)").alias("b"), F.explode("tokens").alias("token"))
    known = sets.groupBy("token").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("n") >= SUPPORT * total)
    first = known.groupBy("n", "a", "b").agg(F.min("token").alias("item"), F.collect_list("token").alias("tokens"))
    return cut(first.select(F.explode("tokens").alias("token"), "item", "n"))


def _with_items(rows: DataFrame, items: DataFrame) -> DataFrame:
    """rows with column items: the distinct items of their tokens."""
    named = items.agg(F.map_from_entries(F.collect_list(F.struct("token", "item"))).alias("names"))  # one row of bounded size
    return rows.join(F.broadcast(named)).withColumn("items", F.array_distinct(F.filter(F.transform("tokens", lambda t: F.try_element_at("names", t)), lambda x: x.isNotNull()))).drop("names")


def _rules(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rule_id, antecedent, verdict, confidence, support) over items, mined from all labelled rows and pruned; and the items."""
    spark = labelled.sparkSession
    total = labelled.count()
    items = _items(labelled, total)
    rows = _with_items(labelled, items).select(F.concat("items", F.array(F.concat(F.lit("v:"), "verdict"))).alias("items"))
    if not total:
        return spark.createDataFrame([], "rule_id bigint, antecedent array<string>, verdict string, confidence double, support double"), items
    model = FPGrowth(itemsCol="items", minSupport=SUPPORT, minConfidence=CONFIDENCE).fit(rows)
    found = model.associationRules.where(F.col("consequent")[0].startswith("v:") & ~F.exists("antecedent", lambda x: x.startswith("v:")))
    found = cut(found.select(F.array_sort("antecedent").alias("antecedent"), F.expr("substring(consequent[0], 3)").alias("verdict"), "confidence", "support").withColumn("rule_id", F.xxhash64("antecedent", "verdict")))
    # A rule goes if a shorter one with the same verdict, made of some of its items, is as sure.
    short = found.select(F.col("antecedent").alias("a"), F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    by_item = found.withColumn("item", F.explode("antecedent"))
    within = (F.col("v") == F.col("verdict")) & (F.size("a") < F.size("antecedent")) & (F.size(F.array_except("a", "antecedent")) == 0) & (F.col("c") >= F.col("confidence"))
    implied = by_item.join(short, (F.col("item") == F.col("a")[0]) & within).select("rule_id").distinct()
    return cut(found.join(implied, "rule_id", "left_anti").select("rule_id", "antecedent", "verdict", "confidence", "support")), items


def mine(labelled: DataFrame) -> DataFrame:
    """labelled (tokens, verdict) -> rules (rule_id, antecedent, verdict, confidence, support) mined from all rows, pruned; a rule for each choice of a token of each of its items. No labels give no rules."""
    rules, items = _rules(labelled)
    alike = items.groupBy("item").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    listed = rules.select("rule_id", F.explode("antecedent").alias("item")).join(alike, "item").groupBy("rule_id").agg(F.collect_list("tokens").alias("tokens"))
    chosen = F.expr("aggregate(tokens, array(CAST(array() AS array<string>)), (done, t) -> flatten(transform(done, p -> transform(t, x -> concat(p, array(x))))))")
    out = rules.drop("antecedent").join(listed, "rule_id").withColumn("antecedent", F.explode(chosen)).withColumn("antecedent", F.array_sort("antecedent"))
    return out.select(F.xxhash64("antecedent", "verdict").alias("rule_id"), "antecedent", "verdict", "confidence", "support")


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, default: str = "allow") -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, mined (the tokens of the mined rule that decided, or null).

    A null url, and one without `://`, has an empty host and path, no rule, and the default verdict, as has any URL that no
    mined rule fits. Repeated rows and null ids stay; other columns are left out; no rows give no rows. Ties between mined
    rules go to the higher confidence, then support, then the first items by name.
    """
    url = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("url"))
    host, path = parts(F.col("url"))
    rows = url.withColumn("host", host).withColumn("path", path)
    name, verdict = fixed_rule(rules)
    rows = rows.withColumn("rule", name).withColumn("fixed", verdict)
    tagged = rows.select("url", "host", "path", "fixed").withColumn("tokens", tokens())
    rules, items = _rules(cut(tagged.where("fixed is not null").select("tokens", F.col("fixed").alias("verdict"))))
    # The inverted index: from a rule's rarest item to the rule.
    ranked = rules.withColumn("item", F.explode("antecedent")).join(items.where("token = item").select("item", "n"), "item")
    index = ranked.groupBy("rule_id").agg(F.min(F.struct("n", "item")).alias("r"), *[F.first(c).alias(c) for c in ("antecedent", "verdict", "confidence", "support")])
    index = cut(index.select(F.col("r.item").alias("item"), "antecedent", "verdict", "confidence", "support"))
    open_urls = tagged.where("fixed is null and url is not null").groupBy("url").agg(F.first("tokens").alias("tokens"), F.count("*").alias("copies"))
    asked = _with_items(open_urls, items).withColumn("item", F.explode("items"))
    fired = asked.join(F.broadcast(index) if index.count() <= BROADCAST_RULES else index, "item").where(F.size(F.array_except("antecedent", "items")) == 0)
    # Of the tokens that are one item, the URL's first by name says which rule it was.
    named = items.groupBy("item").agg(F.sort_array(F.collect_list("token")).alias("alike"))
    names = named.agg(F.map_from_entries(F.collect_list(F.struct("item", "alike"))).alias("names"))
    best = fired.groupBy("url").agg(F.first("copies").alias("copies"), F.first("tokens").alias("tokens"), F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), "antecedent", "verdict")).alias("b"))
    own = F.transform("b.antecedent", lambda i: F.get(F.array_intersect(F.try_element_at("names", i), "tokens"), 0))
    best = cut(best.join(F.broadcast(names)).select("url", "copies", F.array_join(F.array_sort(own), " ").alias("mined"), F.col("b.verdict").alias("found")))
    asking = F.col("fixed").isNull() & F.col("url").isNotNull()
    columns = ["id", "host", "path", "rule", "fixed"]
    judged = spread_join(rows.where(asking).select(*columns, "url"), best, ["url"], "copies", "left").select(*columns, "mined", "found")
    judged = judged.union(rows.where(~asking).select(*columns, F.lit(None).cast("string"), F.lit(None).cast("string")))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("fixed", "found", F.lit(default)).alias("verdict"), "mined")
