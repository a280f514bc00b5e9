"""URL filters: rules first, then a character language-model ratio.

Two smoothed variable-order Markov models over the characters of a URL, one of
accepted and one of rejected URLs, give every URL a length-normalised log-likelihood
difference; a threshold calibrated on the same URLs splits allow from block. A
model's probability of a character starts from the uniform one and is mixed with the
counts after contexts of 0, 1, 2, ... characters, each weighing as its count against
``STRENGTH``, so a context counts for as much as it has been seen.

Everything is DataFrame functions. Gram counts are pre-aggregated and every gram keeps its
own log ratio: the distinct grams of the distinct URLs get their values by equi-joins, and
the characters theirs by one more. A character is scored by the longest gram that was seen.

Defined edge cases: a null url, and one without ``://``, has an empty host and path and
fits no rule; its characters (none for null) are scored all the same; without any
accepted or any rejected URL the models agree and the verdict is allow; repeated rows
count as often as they come; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import cut, discard

ORDER = 3
STRENGTH = 2.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_START, _END = "\x02", "\x03"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty for null or without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def apply_rules(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        rule = F.when(fits, r.text).otherwise(rule)
        verdict = F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def _padded(url: Column) -> Column:
    return F.concat(F.lit(_START * ORDER), F.translate(F.coalesce(url, F.lit("")), _UPPER, _LOWER), F.lit(_END))


def gram_counts(urls: DataFrame) -> DataFrame:
    """(url, accepted boolean) -> (gram, k, a, r): how often each gram of 1 to ORDER + 1
    characters occurs in accepted and in rejected URLs. Grams end anywhere from the last
    padding character on, so that the count of a gram is also its count as a context."""
    text = urls.select(_padded(F.col("url")).alias("u"), F.col("accepted"))
    ends = text.select("u", "accepted", F.explode(F.sequence(F.lit(ORDER), F.length("u"))).alias("i"))
    grams = [F.struct(F.lit(k).alias("k"), F.substring(F.col("u"), F.col("i") - (k - 1), F.lit(k)).alias("gram")) for k in range(1, ORDER + 2)]
    each = ends.select("accepted", F.inline(F.filter(F.array(*grams), lambda g: F.length(g["gram"]) == g["k"])))
    return each.groupBy("k", "gram").agg(F.count_if(F.col("accepted")).alias("a"), F.count_if(~F.col("accepted")).alias("r"))


def log_ratios(counts: DataFrame) -> DataFrame:
    """(gram, k, ratio, back): the smoothed log P(accepted) - log P(rejected) of a gram's last
    character after the others, and what is added where the gram is only a context whose
    next character was never seen: both classes then keep the shorter context's
    probability, lessened by the weight of this one."""
    total = counts.where((F.col("k") == 1) & (F.col("gram") != _START)).agg(F.sum("a").alias("a"), F.sum("r").alias("r")).first()
    mixed = lambda n, c, p: (n + STRENGTH * p) / (c + STRENGTH)
    uniform = F.lit(1.0 / 256)
    level = counts.where("k = 1").select("gram", "a", "r", mixed(F.col("a"), F.lit(total.a or 0), uniform).alias("pa"), mixed(F.col("r"), F.lit(total.r or 0), uniform).alias("pr"))
    out = None
    for k in range(1, ORDER + 2):
        part = level.select("gram", F.lit(k).alias("k"), (F.ln("pa") - F.ln("pr")).alias("ratio"), (F.ln(F.col("r") + STRENGTH) - F.ln(F.col("a") + STRENGTH)).alias("back"))
        out = part if out is None else out.unionByName(part)
        if k <= ORDER:
            context = level.select(F.col("gram").alias("context"), F.col("a").alias("ca"), F.col("r").alias("cr"))
            lower = level.select(F.col("gram").alias("lower"), "pa", "pr")
            grams = counts.where(F.col("k") == k + 1).select("gram", "a", "r", F.substring("gram", 1, k).alias("context"), F.substring("gram", 2, k).alias("lower"))
            level = grams.join(context, "context").join(lower, "lower").select("gram", "a", "r", mixed(F.col("a"), F.col("ca"), F.col("pa")).alias("pa"), mixed(F.col("r"), F.col("cr"), F.col("pr")).alias("pr"))
    return out


def model_row(ratios: DataFrame) -> DataFrame:
    """(k, gram, ratio, back), one row for each gram that was counted."""
    return ratios.select("k", "gram", "ratio", "back")


def gram_values(grams: DataFrame, model: DataFrame) -> DataFrame:
    """(gram, x) for each of the distinct ``grams`` of ORDER + 1 characters: log P(accepted) -
    log P(rejected) of the last character after the longest context seen."""
    seen = lambda k: model.where(F.col("k") == k)
    values = None
    for k in range(1, ORDER + 2):
        out = grams.select(F.substring("gram", ORDER + 2 - k, k).alias("gram"))
        out = (out.distinct() if k <= ORDER else out).join(seen(k).select("gram", "ratio"), "gram", "left")
        x = F.coalesce("ratio", F.lit(0.0))
        if values is not None:
            back = seen(k - 1).select(F.col("gram").alias("context"), F.col("back"))
            out = out.withColumns({"context": F.substring("gram", 1, k - 1), "lower": F.substring("gram", 2, k - 1)}).join(back, "context", "left").join(values.select(F.col("gram").alias("lower"), F.col("x").alias("less")), "lower")
            x = F.coalesce("ratio", F.coalesce("back", F.lit(0.0)) + F.col("less"))
        values = out.select("gram", x.alias("x"))
    return values


def score_urls(urls: DataFrame, model: DataFrame) -> DataFrame:
    """``urls`` (with a column url) and its ``score``, the mean over its characters. Distinct
    URLs are scored once; their characters meet the values of the distinct grams under
    numbers that stand for the URLs."""
    keyed = urls.withColumn("_key", F.coalesce("url", F.lit("")))
    texts = cut(keyed.select("_key").distinct().withColumn("_n", F.monotonically_increasing_id()), "url-texts")
    padded = texts.select("_n", _padded(F.col("_key")).alias("u"))
    chars = padded.select("_n", "u", F.explode(F.sequence(F.lit(ORDER + 1), F.length("u"))).alias("i")).select("_n", F.substring(F.col("u"), F.col("i") - ORDER, F.lit(ORDER + 1)).alias("gram"))
    grams = cut(chars.select("gram").distinct(), "url-distinct-grams")
    values = cut(gram_values(grams, model), "url-values")
    discard(grams)
    scores = chars.join(values, "gram").groupBy("_n").agg(F.round(F.avg("x"), 9).alias("score"))
    out = keyed.join(texts.join(scores, "_n").drop("_n"), "_key").drop("_key")
    out.sources = (texts, values)
    return out


def calibrate(scored: DataFrame) -> float:
    """The score that lies as many standard deviations below the mean of the accepted
    URLs as above that of the rejected ones; -infinity when a class is missing."""
    r = scored.groupBy().agg(
        *[f(F.when(F.col("accepted") == flag, F.col("score"))).alias(f"{name}{int(flag)}") for flag in (True, False) for name, f in (("m", F.avg), ("s", F.stddev_pop))]
    ).first()
    if r.m1 is None or r.m0 is None:
        return float("-inf")
    s1, s0 = max(r.s1, 1e-9), max(r.s0, 1e-9)
    return round((r.m1 * s0 + r.m0 * s1) / (s1 + s0), 9)


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, url, host, path, rule, verdict, score for every row. The rules' own verdicts
    are the accepted and rejected URLs that the two models learn from."""
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url")).withColumns({"host": host, "path": path})
    rule, verdict = apply_rules(F.col("host"), F.col("path"), rules)
    judged = rows.withColumns({"rule": rule, "by_rule": verdict})
    judged = judged.withColumn("accepted", F.col("by_rule") == "allow")
    known = judged.where("by_rule is not null").select("url", "accepted")
    grams = cut(gram_counts(known), "url-grams")
    model = cut(model_row(log_ratios(grams)), "url-model")
    judged = score_urls(judged, model)
    scored = cut(judged, "url-scores")
    discard(grams, model, *judged.sources)
    limit = calibrate(scored.where("accepted is not null"))
    return scored.select("page_id", "url", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("score") >= limit, "allow").otherwise("block")).alias("verdict"), "score")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict", "score")
