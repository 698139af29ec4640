"""Growth of the universe: companies that filings mention, candidates among them, their selection under a cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeline.operators import documents as D

_COMPANIES = "companies array<struct<name:string,ticker:string,role:string,products:array<string>,quote:string>>"
#: An annual report older than this many days counts as none.
STALE_DAYS = 550
#: A usable name of a news query has so many characters at least.
LEAST_NAME = 4


def mentioned(answers: DataFrame, companies: DataFrame, filers: DataFrame) -> DataFrame:
    """One row per company that an answer names: filer, section, name, ticker, role, products, start, end, cik, title, candidate.

    answers: filer, section, section_start, text, answer (JSON); companies: id (cik), ticker, title; filers: filer, cik.
    A quote that is not in the text gives a row without start; the filer itself is left out. candidate is the key by
    which mentions of one company meet: its cik, else its name without legal form.
    """
    each = answers.select("filer", "section", "section_start", "text", F.explode(F.from_json("answer", _COMPANIES)["companies"]).alias("c"))
    each = each.select("filer", "section", F.col("c.name").alias("name"), F.col("c.ticker").alias("ticker"), "c.role", "c.products", D.locate_quote(F.col("text"), F.col("c.quote")).alias("at"), "section_start")
    each = each.select("filer", "section", "name", "ticker", "role", "products", (F.col("section_start") + F.col("at.start")).alias("start"), (F.col("section_start") + F.col("at.end")).alias("end"))
    named = each.filter("start is not null").select(F.col("name").alias("mention"), "ticker").distinct()
    ids = D.resolve_names(named, companies).select(F.col("mention").alias("_n"), F.col("ticker").alias("_t"), F.col("id").alias("cik"))
    titles = companies.groupBy(F.col("id").alias("cik")).agg(F.min("title").alias("title"))
    own = filers.select(F.col("filer").alias("_f"), F.col("cik").alias("_own")).distinct()
    both = each.join(ids, F.col("name").eqNullSafe(F.col("_n")) & F.col("ticker").eqNullSafe(F.col("_t")), "left").join(titles, "cik", "left")
    both = both.join(own, (F.col("filer") == F.col("_f")) & (F.col("cik") == F.col("_own")), "left_anti")
    key = F.coalesce(F.concat(F.lit("cik:"), F.col("cik").cast("string")), F.concat(F.lit("name:"), D.name_key(F.col("name"))))
    return both.select("filer", "section", "name", "ticker", "role", "products", "start", "end", "cik", "title", F.when(F.col("start").isNotNull(), key).alias("candidate"))


def candidates(mentions: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """candidate, name (of the first mention), cik, title, products (known ones), n_filers, n_mentions of mentions with a quote."""
    found = mentions.filter("candidate is not null")
    first = F.struct("filer", "section", "start", "name")
    out = found.groupBy("candidate").agg(F.min_by("name", first).alias("name"), F.max("cik").alias("cik"), F.min("title").alias("title"), F.countDistinct("filer").alias("n_filers"), F.count("*").alias("n_mentions"))
    made = found.select("candidate", F.explode("products").alias("id")).join(taxonomy.select("id"), "id", "left_semi").groupBy("candidate").agg(F.sort_array(F.collect_set("id")).alias("products"))
    none = F.array().cast("array<string>")
    return out.join(made, "candidate", "left").withColumn("products", F.coalesce("products", none))


def recent_forms(filings: DataFrame, as_of: str) -> DataFrame:
    """cik, form of the latest annual filing (cik, form, filing_date) if it is no older than STALE_DAYS."""
    last = filings.groupBy("cik").agg(F.max_by(F.struct("form", "filing_date"), F.struct("filing_date", "form")).alias("f")).select("cik", "f.*")
    return last.filter(F.datediff(F.lit(as_of).cast("date"), "filing_date") <= STALE_DAYS).select("cik", "form")


def select_additions(found: DataFrame, known: DataFrame, rejected: DataFrame, forms: DataFrame, cap: int) -> DataFrame:
    """candidate, name, decision of each candidate: added, or why not.

    In order of most filers, most mentions and name, the first `cap` that pass all tests are added. They are a top-k,
    and the last of them is one row that all others are compared with; no window over all candidates is needed.
    known (cik), rejected (cik, reason) and forms (cik, form) are lookups.
    """
    order = F.struct((-F.col("n_filers")).alias("f"), (-F.col("n_mentions")).alias("m"), "name", "candidate")
    looked = found.join(known.select("cik", F.lit(True).alias("_known")).distinct(), "cik", "left").join(rejected.select("cik", F.col("reason").alias("_reason")), "cik", "left").join(forms.select("cik", F.col("form").alias("_form")), "cik", "left")
    before = (
        F.when(F.col("cik").isNull(), "not a filer").when(F.col("_known"), "already in the universe")
        .when(F.col("_reason").isNotNull(), F.concat(F.lit("rejected in review: "), "_reason")).when(F.size("products") == 0, "makes no known product")
    )
    looked = looked.select("candidate", "name", before.alias("_no"), "_form", order.alias("_order"))
    taken = looked.filter("_no is null and _form is not null").orderBy("_order").limit(cap)
    last = taken.agg(F.max("_order").alias("_last"), F.count("*").alias("_n"))  # one row
    both = looked.crossJoin(F.broadcast(last))
    full = (F.col("_n") >= cap) & (F.col("_last").isNull() | (F.col("_order") > F.col("_last")))
    decision = F.coalesce("_no", F.when(full, "over cap").when(F.col("_form").isNull(), "no annual report").otherwise("added"))
    return both.select("candidate", "name", decision.alias("decision"))


def new_ids(added: DataFrame, taken: DataFrame) -> DataFrame:
    """candidate, id of new nodes (candidate, name, cik): company/<slug>, with the cik behind it where the id is taken (id) or repeats."""
    slug = F.concat(F.lit("company/"), F.array_join(F.regexp_extract_all(F.lower(D.company_name(F.col("name"))), F.lit("[a-z0-9]+"), F.lit(0)), "-"))
    rows = added.select("candidate", "cik", slug.alias("id"))
    first = rows.groupBy("id").agg(F.min("candidate").alias("_first"))
    used = taken.select("id", F.lit(True).alias("_used")).distinct()
    both = rows.join(first, "id").join(used, "id", "left")
    free = F.col("_used").isNull() & (F.col("candidate") == F.col("_first"))
    return both.select("candidate", F.when(free, F.col("id")).otherwise(F.concat_ws("-", "id", F.col("cik").cast("string"))).alias("id"))


def company_query(label: Column | str = "label", aliases: Column | str = "aliases") -> Column:
    """A news query of a company's names as phrases, each once; null if none is long enough and has a letter."""
    label, aliases = (F.col(x) if isinstance(x, str) else x for x in (label, aliases))
    names = F.concat(F.array(label), F.coalesce(aliases, F.array().cast("array<string>")))
    cleaned = F.transform(names, lambda n: F.btrim(F.btrim(n, F.lit(" \t\n\r\f\x0b")), F.lit(",")))
    usable = F.array_distinct(F.filter(cleaned, lambda n: (F.length(n) >= LEAST_NAME) & n.rlike(r"\p{L}")))
    phrases = F.transform(usable, lambda n: F.concat(F.lit('"'), n, F.lit('"')))
    return F.when(F.size(usable) > 0, F.concat(F.lit("("), F.array_join(phrases, " OR "), F.lit(")")))


def theme_query(query: Column | str = "query") -> Column:
    """The stored query of a theme; null (rule W10) if it is blank."""
    return F.nullif(F.btrim(F.col(query) if isinstance(query, str) else query, F.lit(" \t\n\r\f\x0b")), F.lit(""))
