"""Checks of extracted answers: quotes that stand in the text, endpoints named near them, numbers that the quote states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quakeline.functions.scalars import digest, normalised
from quakeline.operators import documents as D

# Words that name nothing by themselves, the reach around a quote, the least score of a company name.
STOP_WORDS = "and the for data center centers system systems equipment product products non high other services".split()
WINDOW, LEAST_SCORE = 300, 0.9
_ITEM = "struct<product:string,input:string,bucket:string,reason:string,description:string,share:double,period:string,basis:string,products:array<string>,supplier:string,customer:string,label:string,quote:string>"
KINDS = ("requires", "disclosed", "produces", "supplies", "new_products")


def keywords(label: Column | str = "label", aliases: Column | str = "aliases") -> Column:
    """Words of three letters and more that name a node, without a plural s."""
    label, aliases = (F.col(x) if isinstance(x, str) else x for x in (label, aliases))
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", label, aliases)), F.lit("[a-z0-9]+"), F.lit(0))
    named = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS))
    return F.array_distinct(F.transform(named, lambda w: F.when(w.endswith("s") & (F.length(w) > 4), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)))


def mentions(text: Column, words: Column) -> Column:
    """Whether a word of the text begins with one of the keywords, whatever its case."""
    pattern = F.concat(F.lit(r"(?iU)\b(?:"), F.array_join(words, "|"), F.lit(")"))
    return F.coalesce((F.size(words) > 0) & F.regexp_like(text, pattern), F.lit(False))


def _heads(texts: DataFrame, of: DataFrame, least: float) -> DataFrame:
    """text, gram, nth: the rarest pairs of neighbouring characters in texts (as of `grams`, counted in `of`), so many that texts alike share one."""
    order = W.partitionBy("text").orderBy(F.coalesce("df", F.lit(0)), "gram", "nth")
    each = texts.join(of, ["gram", "nth"], "left").withColumn("i", F.row_number().over(order))
    shared = F.greatest(F.lit(1), F.ceil((3 * least - 2) / (2 - least) * F.length("text") - 1 - 1e-9))
    return each.filter(F.col("i") <= F.greatest(F.lit(1), F.length("text") - shared)).select("text", "gram", "nth")


def grams(texts: DataFrame) -> DataFrame:
    """text, gram, nth of distinct texts: pairs of neighbouring characters, equal ones numbered from 1; a single character itself."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - 1, F.lit(1))), lambda i: F.substring(F.col("text"), i, F.lit(2)))
    each = texts.filter("text <> ''").select("text", F.explode(pairs).alias("gram")).groupBy("text", "gram").count()
    return each.select("text", "gram", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("nth"))


def alike_names(needles: DataFrame, names: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """Pairs (needle, name, score) of distinct normalised texts (text) with a `name_score` of at least `least`, none left out.

    Of texts with m characters in common order and t in all, at least 3 m - t - 1 pairs of neighbours are equal; a
    ratio of `least` makes that a share of the length of either, and a name that holds the needle has more. So both
    have one of their rarest pairs in common. least is above 0.75.
    """
    b = grams(names)
    of = b.groupBy("gram", "nth").agg(F.count("*").alias("df"))
    both = _heads(grams(needles), of, least).withColumnRenamed("text", "needle").join(_heads(b, of, least).withColumnRenamed("text", "name"), ["gram", "nth"])
    n, m = F.length("needle"), F.length("name")
    pairs = both.select("needle", "name").filter((2 * F.least(n, m) >= least * (n + m)) | F.contains("name", "needle")).distinct()
    near = F.levenshtein("needle", "name") <= (1 - least) * (n + m) + 1e-9  # what is not in order must be added or taken away
    pairs = pairs.filter(near | F.contains("name", "needle"))
    return pairs.withColumn("score", D.name_score(F.col("needle"), F.col("name"))).filter(F.col("score") >= least)


def matched_companies(said: DataFrame, names: DataFrame) -> DataFrame:
    """said (name) -> company: the best of all names (id, label, name) with LEAST_SCORE at least."""
    a = said.select(F.col("name").alias("said"), normalised(D.company_name(F.col("name"))).alias("needle")).distinct()
    b = names.select("id", "label", normalised(F.col("name")).alias("own")).distinct()
    alike = alike_names(a.select(F.col("needle").alias("text")).distinct(), b.select(F.col("own").alias("text")).distinct())
    scored = a.join(alike, "needle").join(b, F.col("name") == F.col("own"))
    return scored.groupBy(F.col("said").alias("name")).agg(F.min_by("id", F.struct((-F.col("score")).alias("s"), "label", "id")).alias("company"))


def checked(answers: DataFrame, taxonomy: DataFrame, names: DataFrame) -> DataFrame:
    """One row per item of answers (node, form, section, section_start, text, answer as JSON): node, form, section, kind,
    kept, item_id, start, end (in the filing), and the item's fields; supplier and customer are ids of companies.

    A quote must stand in the text. requires and produces: their products (taxonomy: id, label, aliases) are known,
    differ, and are named within WINDOW characters of the quote. disclosed: the quote states the share, above 0 and at
    most 1. supplies: both companies are found among names (id, label, name) and differ. Other items are not kept and
    have no item_id. Null or broken answers have no items.
    """
    parsed = F.from_json("answer", ",".join(f"{k} array<{_ITEM}>" for k in KINDS))
    of = lambda k: F.transform(F.coalesce(parsed[k], F.array().cast(f"array<{_ITEM}>")), lambda x: F.struct(F.lit(k).alias("kind"), x.alias("x")))
    tagged = [of(k) for k in KINDS]
    each = answers.select("node", "form", "section", "section_start", "text", F.explode(F.concat(*tagged)).alias("i")).withColumn("at", D.locate_quote(F.col("text"), F.col("i.x.quote")))
    lo = F.greatest(F.lit(0), F.col("at.start") - WINDOW)
    window = F.substring(F.col("text"), lo + 1, F.col("at.end") + WINDOW - lo)
    quote = F.substring(F.col("text"), F.col("at.start") + 1, F.col("at.end") - F.col("at.start"))
    items = each.select("node", "form", "section", F.col("i.kind").alias("kind"), "i.x.*", (F.col("section_start") + F.col("at.start")).alias("start"), (F.col("section_start") + F.col("at.end")).alias("end"), F.col("at.start").alias("_at"), window.alias("_near"), quote.alias("_quote"))
    known = taxonomy.select("id", keywords().alias("words"))
    for end in ("product", "input"):
        items = items.join(known.select(F.col("id").alias(end), F.col("words").alias(f"_{end}")), end, "left")
    said = items.select(F.explode(F.array("supplier", "customer")).alias("name")).filter("name is not null")
    found = matched_companies(said, names)
    for end in ("supplier", "customer"):
        items = items.join(found.select(F.col("name").alias(end), F.col("company").alias(f"_{end}")), end, "left")
    named = lambda end: mentions(F.col("_near"), F.col(f"_{end}"))
    holds = (
        F.when(F.col("kind") == "requires", named("product") & named("input") & (F.col("product") != F.col("input")))
        .when(F.col("kind") == "disclosed", (F.col("share") > 0) & (F.col("share") <= 1) & D.number_in_quote(F.col("_quote"), F.col("share")))
        .when(F.col("kind") == "produces", named("product")).when(F.col("kind") == "supplies", F.col("_supplier") != F.col("_customer")).otherwise(F.lit(True))
    )
    kept = F.col("_at").isNotNull() & F.coalesce(holds, F.lit(False))
    text = lambda *c: F.concat_ws("|", *(F.col(x).cast("string") for x in c))
    parts = (
        F.when(F.col("kind") == "requires", text("product", "input")).when(F.col("kind") == "disclosed", text("share")).when(F.col("kind") == "produces", text("product"))
        .when(F.col("kind") == "supplies", text("_supplier", "_customer")).otherwise(text("label"))
    )
    kind = F.when(F.col("kind") == "new_products", "new").otherwise(F.col("kind"))
    ident = F.concat(F.substring(kind, 1, 3), F.lit("-"), digest(F.concat_ws("|", "node", kind, "section", parts, F.col("_at").cast("string")), 10))
    only = lambda c: F.when(F.col("kind") == "supplies", F.col(f"_{c}"))
    # an unknown product of a supply is left open
    product = F.when((F.col("kind") == "supplies") & F.col("_product").isNull(), None).otherwise(F.col("product"))
    fields = ["input", "bucket", "reason", "description", "share", "period", "basis", "products", "label"]
    return items.select("node", "form", "section", "kind", kept.alias("kept"), F.when(kept, ident).alias("item_id"), "start", "end", product.alias("product"), *fields, only("supplier").alias("supplier"), only("customer").alias("customer"))


def dropped(items: DataFrame) -> DataFrame:
    """node, kind, dropped: items that were not kept."""
    return items.filter("not kept").groupBy("node", "kind").agg(F.count("*").alias("dropped"))


def requires_recall(seed: DataFrame, proposed: DataFrame) -> DataFrame:
    """product, input, found of each seed link: whether extraction proposed it, whatever a review said."""
    links = proposed.select("product", "input", F.lit(True).alias("found")).distinct()
    return seed.select("product", "input").distinct().join(links, ["product", "input"], "left").fillna(False, ["found"])
