"""URL filtering by association rules, with fixed host and path rules on top.

Spark's FP-growth mines combinations of URL tokens together with the label of the labelled rows.  Rules that conclude
the bad label are pruned by support and confidence and dropped where a shorter rule is at least as confident.  Each rule
is indexed by its rarest token; a URL meets the rules of its own tokens only and must hold all tokens of a rule.

A fixed rule such as ("block", "example.org/es/") fits its host and all subdomains when the URL's path starts with the
rule's; the longest fitting rule decides, else the mined rules do.

Defined cases: a null URL, or one without ://, has empty host and path, no tokens, and so the verdict allow; repeated
rows and null ids are judged like others; rows without label, or with null labels only, aren't learnt from; without
labelled rows or bad labels nothing is mined; extra columns are ignored; an empty table gives an empty result.
"""

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import functions as F

from ._store import stored

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
BAD = "label=bad"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_path(url):
    """Host (A-Z lower-cased) and path columns of a URL column; both empty without ://."""
    text = F.coalesce(url, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(text, _PARTS, 1), upper, upper.lower()), F.regexp_extract(text, _PARTS, 2)


def fixed_rule(host, path, rules=RULES):
    """Rule string and verdict of the longest fixed rule that fits, else nulls."""
    best = best_verdict = F.lit(None).cast("string")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        best, best_verdict = F.when(fits, rule).otherwise(best), F.when(fits, verdict).otherwise(best_verdict)
    return best, best_verdict


def tokens(url):
    """Distinct tokens of a URL: host labels, path words and query keys, marked by where they stand; bare numbers are left out."""
    host, path = host_path(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    words = F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}_-]+"), lambda w: (w != "") & ~w.rlike("^[0-9]+$"))
    labels = F.filter(F.split(host, r"\."), lambda w: w != "")
    keys = F.filter(F.transform(F.split(query, "&"), lambda kv: F.regexp_extract(kv, "^([^=]*)", 1)), lambda w: w != "")
    mark = lambda kind, a: F.transform(a, lambda w: F.concat(F.lit(kind), w))
    return F.array_distinct(F.concat(mark("h:", labels), mark("p:", words), mark("q:", keys)))


def mine(spark, labelled, min_support=0.001, min_confidence=0.6, min_rows=20):
    """Rules (antecedent, confidence, support) from labelled(url, bad): token sets that conclude a bad label.

    A rule needs min_support of the labelled rows and at least min_rows of them.
    """
    empty = spark.createDataFrame([], "antecedent array<string>, confidence double, support double")
    baskets = labelled.select(F.concat(tokens(F.col("url")), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items")).where(F.size("items") > 0)
    baskets = stored(spark, baskets, "baskets")  # read several times
    rows = baskets.count()
    if rows < min_rows:
        return empty
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, min_rows / rows)), minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD))).select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support")
    rules = rules.where(F.size("antecedent") > 0)
    # a rule goes when a shorter one inside it is at least as confident; they meet on a shared token
    short = rules.select(F.explode("antecedent").alias("token"), F.col("antecedent").alias("inner"), F.col("confidence").alias("c"))
    longer = rules.select(F.explode("antecedent").alias("token"), "antecedent", "confidence")
    covered = longer.join(short, "token").where((F.size("inner") < F.size("antecedent")) & (F.size(F.array_except("inner", "antecedent")) == 0) & (F.col("c") >= F.col("confidence")))
    return rules.join(covered.select("antecedent").distinct(), "antecedent", "left_anti")


def matched(urls, rules):
    """Best mined rule per distinct url of urls(url): rows (url, mined, confidence)."""
    own = urls.where("url is not null").distinct().withColumn("tokens", tokens(F.col("url")))
    frequency = rules.select(F.explode("antecedent").alias("token")).groupBy("token").count()
    keyed = rules.select("antecedent", "confidence", F.explode("antecedent").alias("token")).join(frequency, "token")
    index = keyed.groupBy("antecedent", "confidence").agg(F.min_by("token", F.struct("count", "token")).alias("token"))
    met = own.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = met.groupBy("url").agg(F.max(F.struct("confidence", "antecedent")).alias("b"))
    return best.select("url", F.concat_ws(" ", "b.antecedent").alias("mined"), F.col("b.confidence").alias("confidence"))


def judge(spark, pages, labels, rules=RULES, min_support=0.001, min_confidence=0.6):
    """Verdict per row of pages(page_id, url): (page_id, host, path, rule, verdict, mined, confidence).

    labels(doc_id, quality, toxic) labels the page with the same id; a row is bad when its quality is 0 or it is toxic.
    """
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"))
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)")
    known = known.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    mined = mine(spark, pages.where("url is not null").join(known, "page_id").select("url", "bad"), min_support, min_confidence)
    best = matched(pages.select("url"), mined)
    host, path = host_path(F.col("url"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    out = pages.join(best, "url", "left").select("page_id", host.alias("host"), path.alias("path"), "mined", "confidence")
    decided = F.coalesce(verdict, F.when(F.col("mined").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", rule.alias("rule"), decided.alias("verdict"), "mined", "confidence")
