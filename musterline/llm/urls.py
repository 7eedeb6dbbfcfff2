"""URL filters: host rules, and a character language-model ratio for what no rule decides.

Two Markov models of variable order are trained on the URLs that the rules decide, one on the allowed and one
on the blocked. The chance of a character after the four before it is interpolated down to shorter contexts
(Witten-Bell: a context seen n times with t different successors trusts itself by n / (n + t)) and ends at a
uniform chance. A URL's score is the mean over its characters of the log ratio of the two models. The
threshold is the one that errs least on the decided URLs, both kinds weighing the same; for that each is
scored with its own counts taken out once. All counts cover all rows, and all is done in DataFrame functions.

Defined results: a null URL or one without ``://`` has an empty host and path, which no rule fits and which is
scored by its end mark alone. Without decided URLs of both kinds the threshold is 0, and a score at the
threshold is allowed. Repeated rows get a row each and count each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from musterline.cluster import cut_lineage
from musterline.llm.decontamination import CAPITALS, SMALL

# The rules of the query.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
CONTEXT = 4
CHARACTERS = 256
START, END = "\x02", "\x03"
UNITS = 1_000_000_000  # scores are summed as whole billionths, so their order does not matter
STEPS = 100  # thresholds are tried in hundredths, between -LIMIT and LIMIT
LIMIT = 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), CAPITALS, SMALL)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as its text; null where none does."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def verdict_of(rule: Column, rules=RULES) -> Column:
    found = F.lit(None).cast("string")
    for text, verdict in rules:
        found = F.when(rule == text, F.lit(verdict)).otherwise(found)
    return found


def _grams(texts: DataFrame, *kept: str) -> DataFrame:
    """A row per character of ``text`` and its end: the character with the ``CONTEXT`` before it."""
    framed = F.concat(F.lit(START * CONTEXT), F.col("text"), F.lit(END))
    count = F.char_length("text") + 1
    grams = F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(framed, i, F.lit(CONTEXT + 1)))
    return texts.select(*kept, F.explode(grams).alias("gram"))


def _chance(count: Column, total: Column, kinds: Column, below: Column) -> Column:
    return F.when(total + kinds > 0, (count + kinds * below) / (total + kinds)).otherwise(below)


def ratios(grams: DataFrame) -> DataFrame:
    """(gram, ratio, allow_less, block_less) of every gram, from (gram, allow, block) counts.

    The last two are the ratios after one occurrence is taken out of the allowed or blocked counts.
    """
    uniform = F.lit(1.0 / CHARACTERS)
    below = None
    for order in range(CONTEXT + 1):
        last = F.substring("gram", CONTEXT + 1 - order, order + 1).alias("g")
        counts = grams.groupBy(last).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        counts = counts.withColumn("context", F.substring("g", 1, order))
        totals = counts.groupBy("context").agg(
            *[F.sum(c).alias(f"{c}_total") for c in ("allow", "block")],
            *[F.sum((F.col(c) > 0).cast("long")).alias(f"{c}_kinds") for c in ("allow", "block")],
        )
        joined = counts.join(totals, "context").withColumn("shorter", F.substring("g", 2, order))
        if below is not None:
            joined = joined.join(below, "shorter")
        chances = []
        for c in ("allow", "block"):
            count, total, kinds = F.col(c), F.col(f"{c}_total"), F.col(f"{c}_kinds")
            lower = uniform if below is None else F.col(f"{c}_p")
            lower_less = uniform if below is None else F.col(f"{c}_q")
            less = F.greatest(count - 1, F.lit(0)), F.greatest(total - 1, F.lit(0))
            chances.append(_chance(count, total, kinds, lower).alias(f"{c}_p1"))
            chances.append(
                _chance(*less, kinds - (count == 1).cast("long"), lower_less).alias(f"{c}_q1")
            )
        now = joined.select("g", *chances)
        renamed = [F.col(f"{c}_{x}1").alias(f"{c}_{x}") for c in ("allow", "block") for x in "pq"]
        below = cut_lineage(now.select(F.col("g").alias("shorter"), *renamed))

    def units(a: str, b: str) -> Column:
        return F.round((F.log(a) - F.log(b)) * UNITS).cast("long")

    return below.select(
        F.col("shorter").alias("gram"),
        units("allow_p", "block_p").alias("ratio"),
        units("allow_q", "block_p").alias("allow_less"),
        units("allow_p", "block_q").alias("block_less"),
    )


def threshold(decided: DataFrame) -> float:
    """The threshold that errs least on (verdict, score, n), both verdicts weighing the same.

    The driver gets one row per verdict and step between the limits, however many URLs there are."""
    step = F.round(F.least(F.greatest(F.col("score"), F.lit(-LIMIT)), F.lit(LIMIT)) * STEPS).cast("int")
    rows = decided.groupBy("verdict", step.alias("step")).agg(F.sum("n").alias("n")).collect()
    total = {v: sum(r.n for r in rows if r.verdict == v) for v in ("allow", "block")}
    if not all(total.values()):
        return 0.0
    at: dict[int, dict[str, int]] = {}
    for r in rows:
        at.setdefault(r.step, {"allow": 0, "block": 0})[r.verdict] += r.n
    best, lost, passed = None, 0, total["block"]
    for step in sorted(at):
        # A threshold just at this step loses the allowed below it and passes the blocked from it on.
        errors = lost / total["allow"] + passed / total["block"]
        if best is None or errors < best[0]:
            best = (errors, (step - 0.5) / STEPS)
        lost, passed = lost + at[step]["allow"], passed - at[step]["block"]
    return best[1]


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict and score (null where a rule decides)."""
    host, path = host_and_path(F.coalesce("url", F.lit("")))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    parts = parts.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    parts = parts.withColumn("decided", verdict_of(F.col("rule"), rules))
    parts = cut_lineage(parts.withColumn("text", F.concat("host", "path")))
    texts = cut_lineage(parts.groupBy("text", "decided").agg(F.count(F.lit(1)).alias("n")))
    kinds = [F.sum(F.when(F.col("decided") == c, F.col("n")).otherwise(0)).alias(c) for c in ("allow", "block")]
    counts = cut_lineage(_grams(texts, "decided", "n").groupBy("gram").agg(*kinds))
    table = cut_lineage(ratios(counts))
    met = _grams(texts, "text", "decided", "n").join(table, "gram")
    own = F.when(F.col("decided") == "allow", F.col("allow_less"))
    own = own.when(F.col("decided") == "block", F.col("block_less")).otherwise(F.col("ratio"))
    mean = (F.sum(own) / F.count(F.lit(1)) / UNITS).alias("score")
    scores = cut_lineage(met.groupBy("text", "decided", "n").agg(mean))
    cut = threshold(scores.filter(F.col("decided").isNotNull()).select(F.col("decided").alias("verdict"), "score", "n"))
    open_scores = scores.filter(F.col("decided").isNull()).select("text", "score")
    open_ = parts.filter(F.col("decided").isNull()).drop("decided").join(open_scores, "text")
    open_ = open_.withColumn("verdict", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    known = parts.filter(F.col("decided").isNotNull()).withColumnRenamed("decided", "verdict")
    known = known.withColumn("score", F.lit(None).cast("double"))
    columns = ["page_id", "host", "path", "rule", "verdict", "score"]
    return known.select(*columns).unionByName(open_.select(*columns))
