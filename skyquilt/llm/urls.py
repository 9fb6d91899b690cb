"""URL filter: rules first, then a ratio of character language models.

Two smoothed variable-order Markov models are counted, one over the URLs that the rules allow and one over
those they block. A character's probability backs off from the longest context to the shorter ones by
interpolation (each order weighs by its own evidence). A URL that no rule fits is scored by the mean
difference of the two log-likelihoods per character; the threshold is calibrated so that on URLs held out of
the counts both kinds of error are equally frequent.

The alphabet is folded to 40 symbols, so a model has 40**3 = 64,000 entries at any size of the input, one for every
gram that a URL can hold, seen or not; that bound is what makes it fit for broadcasting.

Defined results: a null URL, and one without ``://``, has empty host and path and no rule and is judged by the
method on its text (null: empty); an empty URL is allowed; without any labelled URL everything is allowed;
repeated rows give repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_spread, table

#: (verdict, host and path)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
ORDER = 3
ALPHABET = "abcdefghijklmnopqrstuvwxyz0./-_?=&:#%^$~"
PRIOR = 4.0
HELD_OUT = 5
BINS = 400
SIDES = ("allow", "block")


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """Adds host, path, rule and rule_verdict; of several fitting rules the longest wins."""
    split = pages.withColumn("host", F.coalesce(host_of(F.col("url")), F.lit(""))).withColumn("path", F.coalesce(path_of(F.col("url")), F.lit("")))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, slash, rest = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return split.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def folded(url: Column) -> Column:
    """The URL over ALPHABET, with ^ before and $ after it."""
    low = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "[1-9]", "0")
    return F.concat(F.lit("^" * (ORDER - 1)), F.regexp_replace(low, r"[^a-z0./\-_?=&:#%]", "~"), F.lit("$"))


def grams(urls: DataFrame, *keys: str) -> DataFrame:
    """One row per character with its context: ``gram`` has ORDER symbols, of which the last is the character."""
    text = folded(F.col("url"))
    at = F.sequence(F.lit(1), F.length(text) - (ORDER - 1))
    return urls.select(*keys, text.alias("__text"), F.explode(at).alias("__at")).select(*keys, F.substring(F.col("__text"), F.col("__at"), F.lit(ORDER)).alias("gram"))


def model(labelled: DataFrame) -> DataFrame:
    """For every gram over ALPHABET, seen or not, its log-probability ratio, accepted over rejected.

    An order's estimate is (count + PRIOR * the next shorter order's estimate) / (count of context + PRIOR), so a gram
    whose context was never seen has the estimate of the longest suffix that was.
    """
    size = len(ALPHABET)
    counted = [F.count_if(F.col("rule_verdict") == s).cast("double").alias(f"n_{s}") for s in SIDES]
    counts = cut(grams(labelled, "rule_verdict").groupBy("gram").agg(*counted))
    letter = lambda place: F.substring(F.lit(ALPHABET), (F.floor(F.col("id") / size**place) % size + 1).cast("int"), F.lit(1))
    out = labelled.sparkSession.range(size**ORDER, numPartitions=4).select(F.concat(*[letter(k) for k in range(ORDER)]).alias("gram"))
    for order in range(1, ORDER + 1):
        seen = counts.groupBy(F.expr(f"right(gram, {order})").alias("s")).agg(*[F.sum(f"n_{s}").alias(f"g{order}_{s}") for s in SIDES])
        around = counts.groupBy(F.expr(f"left(right(gram, {order}), {order - 1})").alias("c")).agg(*[F.sum(f"n_{s}").alias(f"c{order}_{s}") for s in SIDES])
        out = out.join(F.broadcast(seen), F.expr(f"right(gram, {order})") == F.col("s"), "left").drop("s")
        out = out.join(F.broadcast(around), F.expr(f"left(right(gram, {order}), {order - 1})") == F.col("c"), "left").drop("c")
    out = out.fillna(0.0)
    for s in SIDES:
        p = reduce(lambda lower, k: (F.col(f"g{k}_{s}") + PRIOR * lower) / (F.col(f"c{k}_{s}") + PRIOR), range(1, ORDER + 1), F.lit(1.0 / size))
        out = out.withColumn(f"p_{s}", p)
    return out.select("gram", F.log(F.col("p_allow") / F.col("p_block")).alias("ratio"))


def scored(urls: DataFrame, ratios: DataFrame) -> DataFrame:
    """url and score, the mean ratio over its characters."""
    return grams(urls, "url").join(F.broadcast(ratios), "gram").groupBy("url").agg(F.avg("ratio").alias("score"))


def threshold(scores: DataFrame) -> float:
    """Where, over BINS steps, the shares of allowed URLs below and blocked URLs at or above are closest, in the middle of equal ones; 0 without both kinds.

    ``scores`` has rule_verdict and score; only a histogram of BINS rows reaches the driver.
    """
    span = scores.agg(F.min("score"), F.max("score")).first()
    if span[0] is None or span[0] == span[1]:
        return 0.0
    width = (span[1] - span[0]) / BINS
    bin_of = F.least(F.floor((F.col("score") - span[0]) / width), F.lit(BINS - 1))
    rows = {r.b: r for r in scores.groupBy(bin_of.alias("b")).agg(F.count_if(F.col("rule_verdict") == "allow").alias("allow"), F.count_if(F.col("rule_verdict") == "block").alias("block")).collect()}
    allow, block = sum(r.allow for r in rows.values()), sum(r.block for r in rows.values())
    if not allow or not block:
        return 0.0
    gaps, missed, passed = [], 0, block
    for b in range(BINS + 1):
        gaps.append(abs(missed / allow - passed / block))
        if b in rows:
            missed, passed = missed + rows[b].allow, passed - rows[b].block
    closest = [b for b, gap in enumerate(gaps) if gap == min(gaps)]
    return span[0] + (closest[0] + closest[-1]) / 2 * width


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and, where the method decided, its score."""
    known = ruled(pages.select("page_id", "url"), rules).withColumn("__url", F.coalesce("url", F.lit("")))
    urls = known.select(F.col("__url").alias("url"), "rule_verdict").distinct()
    labelled = urls.filter("rule_verdict is not null")
    held = F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) == 0
    trial = cut(model(labelled.filter(~held)))
    limit = threshold(scored(labelled.filter(held), trial).join(labelled, "url"))
    scores = scored(urls.filter("rule_verdict is null"), cut(model(labelled))).withColumnRenamed("url", "__url")
    by_method = F.when((F.col("score") >= limit) | (F.col("__url") == ""), "allow").otherwise("block")
    out = lambda df, verdict, score: df.select("page_id", "host", "path", "rule", verdict.alias("verdict"), score.alias("score"))
    by_rule = out(known.filter("rule is not null"), F.col("rule_verdict"), F.lit(None).cast("double"))
    return by_rule.unionByName(out(join_spread(known.filter("rule is null"), scores, "__url"), by_method, F.col("score")))


def query(spark, sf_dir):
    """op7: a verdict on the url of every page."""
    return judge(table(spark, sf_dir, "pages"))
