"""URL filters: written rules first, then association rules that FP-growth mines from labels.

Everything on the main path is DataFrame or SQL functions (FP-growth is Spark's own).

Defined results: a null url, or one without ``://``, has an empty host and path, no tokens and
so no mined rule; it is allowed unless a written rule fits. Null labels and pages without label
are not mined. Repeated pages give a row each. No labelled page: no mined rules; no page: no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_ITEM = "=block"
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.5
MIN_COUNT = 10
DEVIATIONS = 6.0


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The written rules.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def written_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, as a struct of its name and verdict; null if none fits."""
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fit = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        fits = F.when(fit, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(fits)
    return fits


def url_tokens(url: Column) -> Column:
    """Distinct tokens: scheme, each label of the host with the kind, path words, query keys, fragment.

    Numbers become ``#`` so that the tokens are a vocabulary, not an id.
    """
    text = F.coalesce(url, F.lit(""))
    no_digits = lambda c: F.regexp_replace(c, r"[0-9]+", "#")
    kinds = [
        ("s:", F.split(F.regexp_extract(text, r"(?s)^(.*?)://", 1), "/")),
        ("h:", F.split(host_of(url), r"\.")),
        ("p:", F.split(no_digits(path_of(url)), r"[/._-]+")),
        ("q:", F.regexp_extract_all(text, F.lit(r"[?&]([^=&#]*)"), F.lit(1))),
        ("f:", F.split(no_digits(F.regexp_extract(text, r"(?s)#(.*)$", 1)), "#")),
    ]

    def marked(kind: str):  # a function of one parameter: with a second one Spark passes the element's position
        return lambda x: F.concat(F.lit(kind), x)

    parts = [F.transform(F.filter(a, lambda x: x != ""), marked(k)) for k, a in kinds]
    return F.when(text.contains("://"), F.array_sort(F.array_distinct(F.concat(*parts)))).otherwise(F.array().cast("array<string>"))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT) -> DataFrame:
    """Token combinations that imply a block: ``tokens array<string>, confidence, support``.

    ``labelled`` has ``tokens`` and a boolean ``bad``. A rule needs ``min_support`` of all baskets, and
    ``min_count`` of them at least, that have its tokens and are bad; its confidence must reach
    ``min_confidence`` and lie ``DEVIATIONS`` standard errors above the share of bad baskets, since
    mining tries very many combinations and chance in a few pages must not make a rule.
    """
    baskets = labelled.where(F.col("bad").isNotNull()).select(
        F.concat(F.col("tokens"), F.when(F.col("bad"), F.array(F.lit(BLOCK_ITEM))).otherwise(F.array().cast("array<string>"))).alias("items")
    )
    counted = labelled.where(F.col("bad").isNotNull()).agg(F.count("*").alias("n"), F.count_if("bad").alias("bad")).first()
    n, base = counted.n, counted.bad / max(1, counted.n)
    share = min(1.0, max(min_support, min_count / n)) if n else 1.0
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(F.element_at("consequent", 1) == BLOCK_ITEM).select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")
    held = F.col("support") * n / F.col("confidence")  # baskets that have the tokens
    return rules.where((F.col("confidence") - base) * F.sqrt(held) >= DEVIATIONS * (base * (1 - base)) ** 0.5)


def _anchors(rules: DataFrame, frequency: DataFrame) -> DataFrame:
    """Each rule under its rarest token: the postings of the inverted index."""
    held = rules.select("tokens", "confidence", "support", F.explode("tokens").alias("token")).join(frequency, "token", "left")
    return held.groupBy("tokens", "confidence", "support").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("anchor"))


def mined_matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The most confident mined rule of each distinct url: ``url, tokens, confidence, support``.

    A url's tokens look up the rules under their anchors; a rule fits if the url has all its tokens.
    """
    frequency = urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    index = _anchors(rules, frequency).select("anchor", F.col("tokens").alias("rule_tokens"), "confidence", "support")
    found = (
        urls.select("url", "tokens", F.explode("tokens").alias("anchor"))
        .join(index, "anchor")
        .where(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    )
    return found.groupBy("url").agg(F.max(F.struct("confidence", "support", "rule_tokens")).alias("mined"))


def filter_urls(pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url", label_id: str = "doc_id", bad: str = "toxic", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row per page: id, host, path, written rule, verdict and the mined rule that decided, if any."""
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    marks = labels.select(F.col(label_id).alias("page_id"), (F.col(bad) > 0).alias("bad")).groupBy("page_id").agg(F.max("bad").alias("bad"))
    labelled = base.join(marks, "page_id").select(url_tokens(F.col("url")).alias("tokens"), "bad")
    mined = mine_rules(labelled, min_support, min_confidence, min_count)
    urls = base.where("url is not null").select("url").distinct().withColumn("tokens", url_tokens(F.col("url")))
    matches = mined_matches(urls, mined)
    judged = base.where("url is not null").join(matches, "url", "left").unionByName(base.where("url is null").withColumn("mined", F.lit(None).cast(matches.schema["mined"].dataType)))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = judged.select("page_id", host.alias("host"), path.alias("path"), "mined").withColumn("fit", written_rule(F.col("host"), F.col("path"), rules))
    return judged.select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(F.col("mined").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("fit").isNull(), F.array_join("mined.rule_tokens", " ")).alias("mined_rule"),
        F.when(F.col("fit").isNull(), F.col("mined.confidence")).alias("mined_confidence"),
    )
