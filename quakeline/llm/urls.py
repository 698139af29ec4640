"""URL filter: host and path rules, then the likelihood ratio of two variable-order character models of whole URLs.

The models are Witten-Bell mixtures of contexts of 0 to ORDER characters, one learned from the URLs that the rules
allow, one from those that they block. A URL's score is the difference of its log-likelihoods, divided by its length;
the cut is calibrated on rule-judged URLs that neither model has seen. DataFrame operations only: the models are
tables of n-grams, which grow with the alphabet of the corpus, and only distinct n-grams are ever joined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quakeline.llm.common import lower_ascii, stored

#: (rule, verdict): host up to the first slash, then the beginning of the path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
ORDER = 4
#: Character that fills the context before a URL, and the size of the alphabet under the shortest context.
PAD, ALPHABET = "\x02", 256
#: Distinct n-grams up to this number (about 60 bytes each) are broadcast to the scoring; more are joined by a shuffle.
BROADCAST_GRAMS = 300_000
#: Parts into which the rows of each gram are dealt otherwise.
SALTS = 16


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _grams(text: Column) -> Column:
    """The ORDER + 1 characters that end at each position."""
    padded = F.concat(F.lit(PAD * ORDER), text)
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))).otherwise(F.array().cast("array<string>"))


@dataclass
class Ratio:
    """gram -> difference of log-likelihoods, and the calibrated cut of the score."""

    grams: DataFrame
    cut: float


def _likelihoods(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """gram, ratio for each wanted gram, by Witten-Bell from the shortest context to the longest."""
    out = wanted.withColumns({"allow_p": F.lit(1.0 / ALPHABET), "block_p": F.lit(1.0 / ALPHABET)})
    for k in range(ORDER + 1):
        ends = counts.groupBy(F.substring("gram", ORDER + 1 - k, k + 1).alias("g")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        context = ends.groupBy(F.substring("g", 1, k).alias("x")).agg(*(e for c in ("allow", "block") for e in (F.sum(c).alias(f"{c}_n"), F.count(F.when(F.col(c) > 0, 1)).alias(f"{c}_t"))))
        out = out.withColumns({"g": F.substring("gram", ORDER + 1 - k, k + 1), "x": F.substring("gram", ORDER + 1 - k, k)})
        # the empty context is one row, not a key that all rows share
        out = out.join(ends, "g", "left")
        out = out.join(context, "x", "left") if k else out.crossJoin(F.broadcast(_one(context.drop("x"))))
        mixed = lambda c: F.when(F.coalesce(F.col(f"{c}_n"), F.lit(0)) > 0, (F.coalesce(F.col(c), F.lit(0)) + F.col(f"{c}_t") * F.col(f"{c}_p")) / (F.col(f"{c}_n") + F.col(f"{c}_t"))).otherwise(F.col(f"{c}_p"))
        out = out.select("gram", mixed("allow").alias("allow_p"), mixed("block").alias("block_p"))
    return out.select("gram", (F.log("allow_p") - F.log("block_p")).alias("ratio"))


def _one(row: DataFrame) -> DataFrame:
    """The one row of a table that has one at most; nulls if it has none."""
    return row.agg(*(F.max(c).alias(c) for c in row.columns))


def _scored(urls: DataFrame, grams: DataFrame, few: bool) -> DataFrame:
    """text, score of each distinct text: mean ratio of its characters, 0 without any."""
    each = urls.select("text", F.explode(_grams(F.col("text"))).alias("gram"))
    if few:
        each = each.join(F.broadcast(grams), "gram")
    else:  # a gram that most URLs have is met in SALTS places
        salted = grams.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        each = each.withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int")).join(salted, ["gram", "salt"])
    return each.groupBy("text").agg(F.avg("ratio").alias("score"))


def judge(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """Per row of pages (page_id, url): page_id, host, path, rule, verdict, score (null where a rule decides).

    Null URLs and those without :// have an empty host and path, which no rule fits; the score is that of the whole
    URL all the same, 0 for null and empty ones. With URLs of one class only, everything that no rule judges is
    allowed. Repeated rows are judged alike, long URLs are read whole, other columns don't matter, and an empty table
    gives an empty result.
    """
    split = pages.select("page_id", F.coalesce("url", F.lit("")).alias("text"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    split = split.withColumns({"rule": rule, "says": says})
    texts = stored(split.groupBy("text", "says").agg(F.count("*").alias("n")).withColumn("aside", F.pmod(F.xxhash64("text"), F.lit(5)) == 0))
    learned = texts.filter("says is not null and not aside").select("says", F.explode(_grams(F.col("text"))).alias("gram"))
    counts = stored(learned.groupBy("gram").agg(F.count(F.when(F.col("says") == "allow", 1)).alias("allow"), F.count(F.when(F.col("says") == "block", 1)).alias("block")))
    judged = texts.filter("says is null or aside")
    wanted = judged.select(F.explode(_grams(F.col("text"))).alias("gram")).distinct()
    grams = stored(_likelihoods(counts, wanted))
    scores = stored(_scored(judged.select("text").distinct(), grams, grams.count() <= BROADCAST_GRAMS))
    known = scores.join(texts.filter("aside and says is not null"), "text").groupBy(F.round("score", 2).alias("cut")).agg(F.count(F.when(F.col("says") == "allow", 1)).alias("good"), F.count(F.when(F.col("says") == "block", 1)).alias("bad"))
    every = known.agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"))
    # one row per hundredth of the score: a table of bounded size
    below = W.orderBy("cut").rowsBetween(W.unboundedPreceding, -1)
    kept = F.coalesce(F.sum("bad").over(below), F.lit(0)) / F.col("all_bad") - F.coalesce(F.sum("good").over(below), F.lit(0)) / F.col("all_good")
    best = known.crossJoin(F.broadcast(every)).filter("all_good > 0 and all_bad > 0").withColumns({"gain": kept, "before": F.lag("cut").over(W.orderBy("cut"))}).orderBy(F.desc("gain"), "cut").limit(1).collect()
    # in the middle of the gap between the scores on either side
    cut = float("-inf") if not best else best[0]["cut"] - 0.005 if best[0]["before"] is None else (best[0]["cut"] + best[0]["before"]) / 2
    score = F.coalesce("score", F.lit(0.0))
    out = split.join(scores, "text", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("says", F.when(score >= cut, "allow").otherwise("block")).alias("verdict"), F.when(F.col("rule").isNull(), score).alias("score"))
