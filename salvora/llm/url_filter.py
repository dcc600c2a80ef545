"""URL filters: host and path rules, and for URLs without a rule a ratio of two character language models.

URLs that rules accept and URLs that rules reject train one variable-order Markov model each. A model gives a character after its last k, by default two,
characters; each order is smoothed with the next lower one, P_k = (n_k + b * P_(k-1)) / (n_context + b), down to the uniform
distribution. Models are tables over a power of a fixed alphabet, so their size has a proven bound and they are broadcast. The score of a URL is the
difference of the two log-likelihoods by length. The models learn from some four fifths of the URLs that rules decide, by a seeded hash of the URL; the threshold is calibrated on
the rest, which no model has seen.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salvora.session import cut

#: (verdict, host and path). A rule fits its host and all subdomains.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Rules are a literal in the plan; longer lists are refused.
MAX_RULES = 10_000
#: '^' pads the start, '$' ends, '0' stands for every digit and '~' for everything else.
ALPHABET = "^abcdefghijklmnopqrstuvwxyz0/.-_?=&#:%+~$"
SMOOTHING = 1.0
#: Characters of a context. The table has the alphabet's size to the power of one more: 68,921 rows for two, 2.8 million for three, which is the most.
ORDER, MOST_ORDER = 2, 3
#: URLs are held out for calibration by the first digit of a hash of them and the seed.
SEED, HELD = "7", "^[012]"
#: Score steps in which thresholds are tried.
STEPS = 100
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased, and path; both empty for null and where there is no '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", 2)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as written, and its verdict; null without one. Of equal rules the first holds."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    names, verdicts = [], []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        base, slash, rest = rule.partition("/")
        fits = ((host == base) | F.endswith(host, F.lit(f".{base}"))) & F.startswith(path, F.lit(slash + rest))
        names.append(F.when(fits, F.lit(rule)))
        verdicts.append(F.when(fits, F.lit(verdict)))
    none = F.lit(None).cast("string")
    return F.coalesce(*names, none), F.coalesce(*verdicts, none)


def folded(url: Column) -> Column:
    """A URL in the model's alphabet; null as empty."""
    low = F.regexp_replace(F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER), "[0-9]", "0")
    return F.regexp_replace(low, "[^a-z0/.\\-_?=&#:%+]", "~")


def held_out(text: Column) -> Column:
    """Whether a folded URL calibrates the threshold; three sixteenths of all do."""
    return F.regexp_like(F.md5(F.concat(text, F.lit(SEED))), F.lit(HELD))


def grams(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """urls with a column `code` for each character and the end: the characters of its context and itself, as a number."""
    size = len(ALPHABET)
    codes = F.transform(F.split(F.concat(F.lit(ALPHABET[0] * order), F.col("folded"), F.lit(ALPHABET[-1])), ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)

    def code(i: Column) -> Column:
        out = F.element_at("codes", i)
        for k in range(1, order + 1):
            out = out * size + F.element_at("codes", i + k)
        return out

    return urls.withColumn("codes", codes).withColumn("code", F.explode(F.transform(F.sequence(F.lit(1), F.length("folded") + 1), code))).drop("codes")


def model(counts: DataFrame, smoothing: float = SMOOTHING, order: int = ORDER) -> DataFrame:
    """counts: (code, good, bad) with at most one row for each code. (code, ratio) for all codes of the order."""
    if not 0 <= order <= MOST_ORDER:
        raise ValueError(f"the order is 0 to {MOST_ORDER}")
    size = len(ALPHABET)
    spark = counts.sparkSession
    dense = spark.range(size ** (order + 1)).select(F.col("id").cast("int").alias("code")).join(counts, "code", "left").fillna(0, ["good", "bad"])
    # of each order k: the last k + 1 characters, and the k before the last
    keys = {f"gram{k}": (F.col("code") % size ** (k + 1)).cast("int") for k in range(order + 1)} | {f"context{k}": F.floor(F.col("code") % size ** (k + 1) / size).cast("int") for k in range(order + 1)}
    dense = cut(dense.select("code", *(F.col(x).cast("double").alias(x) for x in ("good", "bad")), *(c.alias(k) for k, c in keys.items())))
    for key in keys:
        dense = dense.join(F.broadcast(dense.groupBy(key).agg(F.sum("good").alias(f"good_{key}"), F.sum("bad").alias(f"bad_{key}"))), key)

    def logp(x: str) -> Column:
        p = F.lit(1.0 / size)
        for k in range(order + 1):
            p = (F.col(f"{x}_gram{k}") + F.lit(float(smoothing)) * p) / (F.col(f"{x}_context{k}") + F.lit(float(smoothing)))
        return F.log(p)

    return dense.select("code", (logp("good") - logp("bad")).alias("ratio"))


def threshold(scores: DataFrame) -> DataFrame:
    """scores: (score, good, bad). One row, `least`: the middle of the score steps that best part good from bad; null if either is missing."""
    steps = scores.groupBy(F.floor(F.col("score") * STEPS).alias("step")).agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    # scores lie between the logs of the least and the largest ratio, so the steps are few and fixed in number
    every = steps.agg(F.collect_list(F.struct("step", "g", "b")).alias("all"), F.sum("g").alias("sg"), F.sum("b").alias("sb"))
    gain = lambda edge: F.aggregate("all", F.lit(0.0), lambda acc, x: acc + F.when(x["step"] >= edge["step"], F.try_divide(x["g"], F.col("sg"))).otherwise(F.lit(0.0)) + F.when(x["step"] < edge["step"], F.try_divide(x["b"], F.col("sb"))).otherwise(F.lit(0.0)))
    tried = every.select("sg", "sb", F.transform("all", lambda e: F.struct(F.round(gain(e), 9).alias("gain"), e["step"].alias("step"))).alias("tried"))
    best = F.array_max("tried")
    tied = F.filter("tried", lambda x: x["gain"] == best["gain"])
    return tried.select(F.when((F.col("sg") > 0) & (F.col("sb") > 0), (F.array_min(F.transform(tied, lambda x: x["step"])) + best["step"]) / 2.0 / STEPS).alias("least"))


def judge(pages: DataFrame, url: str = "url", key: str = "page_id", rules: tuple = RULES, order: int = ORDER) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of pages.

    Without a rule the verdict is `allow` if the score reaches the calibrated threshold, else `block`; where rules accept or reject no URL at all there is
    nothing to learn from and the rest are allowed; where none of a kind is held out, the threshold is calibrated on all that rules decide. Null and empty URLs have empty host and path and are scored as an empty text. Equal
    URLs are scored once, however many rows share them. An empty table gives no rows.
    """
    host, path = host_path(F.col("url"))
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"), folded(F.col("url")).alias("folded"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("by_rule", verdict)
    forms = cut(rows.groupBy("folded").agg(F.count_if(F.col("by_rule") == "allow").alias("good"), F.count_if(F.col("by_rule") == "block").alias("bad")))
    counts = grams(forms.filter(F.expr("good + bad > 0") & ~held_out(F.col("folded"))), order).groupBy("code").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    ratios = model(counts, order=order)
    scored = grams(forms, order).join(F.broadcast(ratios), "code").groupBy("folded").agg((F.sum("ratio") / F.count("*")).alias("score"), F.first("good").alias("good"), F.first("bad").alias("bad"))
    scored = cut(scored)
    ruled = scored.filter("good + bad > 0")
    least = threshold(ruled.filter(held_out(F.col("folded")))).crossJoin(F.broadcast(threshold(ruled).withColumnRenamed("least", "otherwise"))).select(F.coalesce("least", "otherwise").alias("least"))  # one row each
    judged = rows.join(scored.select("folded", "score"), "folded").crossJoin(F.broadcast(least))  # one row
    by_model = F.when(F.col("least").isNull() | (F.col("score") >= F.col("least")), F.lit("allow")).otherwise(F.lit("block"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_model).alias("verdict"), "score")


def op7_url_filter(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict for every page."""
    return judge(pages).drop("score")


def _sql() -> str:
    n, b = len(ALPHABET), SMOOTHING
    ordered = sorted(RULES, key=lambda r: -len(r[1]))
    fits = [f"(host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '{r[len(r.partition('/')[0]):]}')" for _, r in ordered]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r}'" for f, (_, r) in zip(fits, ordered)) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _) in zip(fits, ordered)) + " END"
    low = "translate({}, '" + UPPER + "', '" + LOWER + "')"
    logs, sums = {}, []
    for x in ("good", "bad"):
        p = f"{1 / n!r}"
        for k in range(ORDER + 1):
            gram = f"code % {n ** (k + 1)}"
            sums += [f"sum({x}) OVER (PARTITION BY {gram}) AS {x}_gram{k}", f"sum({x}) OVER (PARTITION BY ({gram}) // {n}) AS {x}_context{k}"]
            p = f"(({x}_gram{k} + {b} * {p}) / ({x}_context{k} + {b}))"
        logs[x] = f"ln({p})"
    sums = ", ".join(sums)
    gain = "round(sum(CASE WHEN y.step >= x.step THEN y.g ELSE 0 END) / (SELECT sum(g) FROM {0}) + sum(CASE WHEN y.step < x.step THEN y.b ELSE 0 END) / (SELECT sum(b) FROM {0}), 9)"
    best = "SELECT (min(step) + max(step)) / 2.0 / {1} AS least FROM (SELECT x.step, " + gain + " AS gain FROM {0} x, {0} y GROUP BY x.step) WHERE gain = (SELECT max(gain) FROM (SELECT " + gain + " AS gain FROM {0} x, {0} y GROUP BY x.step))"
    return rf"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, {low.format("regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1)")} AS host, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path,
      regexp_replace(regexp_replace({low.format("url")}, '[0-9]', '0', 'g'), '[^a-z0/.\-_?=&#:%+]', '~', 'g') AS folded FROM u),
r AS (SELECT *, {rule} AS rule, {verdict} AS by_rule FROM h),
f AS (SELECT folded, count(*) FILTER (by_rule = 'allow') AS good, count(*) FILTER (by_rule = 'block') AS bad FROM r GROUP BY folded),
p AS (SELECT folded, good, bad, '^^' || folded || '$' AS s, unnest(range(1, length(folded) + 2)) AS i FROM f),
g AS (SELECT folded, good, bad, CAST(((instr('{ALPHABET}', substr(s, i, 1)) - 1) * {n} + instr('{ALPHABET}', substr(s, i + 1, 1)) - 1) * {n} + instr('{ALPHABET}', substr(s, i + 2, 1)) - 1 AS INTEGER) AS code FROM p),
c AS (SELECT code, sum(good) AS good, sum(bad) AS bad FROM g WHERE NOT regexp_matches(md5(folded || '{SEED}'), '{HELD}') GROUP BY code),
d AS (SELECT CAST(k.code AS INTEGER) AS code, CAST(coalesce(good, 0) AS DOUBLE) AS good, CAST(coalesce(bad, 0) AS DOUBLE) AS bad FROM range({n**3}) k(code) LEFT JOIN c ON c.code = k.code),
e AS (SELECT code, good, bad, {sums} FROM d),
m AS (SELECT code, {logs['good']} - {logs['bad']} AS ratio FROM e),
s AS (SELECT folded, any_value(good) AS good, any_value(bad) AS bad, sum(ratio) / count(*) AS score FROM g JOIN m USING (code) GROUP BY folded),
w AS (SELECT floor(score * {STEPS}) AS step, sum(good) AS g, sum(bad) AS b FROM s WHERE good + bad > 0 GROUP BY 1),
b AS (SELECT floor(score * {STEPS}) AS step, sum(good) AS g, sum(bad) AS b FROM s WHERE good + bad > 0 AND regexp_matches(md5(folded || '{SEED}'), '{HELD}') GROUP BY 1),
t AS (SELECT CASE WHEN (SELECT least(sum(g), sum(b)) FROM w) > 0 THEN CASE WHEN (SELECT least(sum(g), sum(b)) FROM b) > 0 THEN ({best.format("b", STEPS)}) ELSE ({best.format("w", STEPS)}) END END AS least)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN least IS NULL OR score >= least THEN 'allow' ELSE 'block' END) AS verdict FROM r JOIN s USING (folded), t
"""


OP7_SQL = _sql()
