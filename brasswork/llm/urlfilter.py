"""URL filter (operator 9): rules first, then a ratio of two character language models. DataFrame functions only.

Host and path of a URL (see `split_url`) are the text. Two variable-order Markov models, of accepted and of rejected
URLs, predict each character from up to `ORDER` characters before it; shorter contexts smooth longer ones:

    p_k(c | ctx_k) = (n(ctx_k c) + BETA * p_(k-1)(c)) / (n(ctx_k) + BETA),   p_(-1) = 1 / 256

Counts are over all URLs: the n-grams of ORDER + 1 characters are counted once, by class and fold, and the shorter ones
are sums of those by their last characters, order by order. A URL's score is the mean of its n-grams' log-ratios, i.e.
the length-normalised difference of the log-likelihoods.

Examples are labelled by the rules' own verdicts and, where no rule judges, by seed words: a URL whose host has one of
them as a part between dots and hyphens is rejected, any other is taken for accepted. A label never scores its own
URL: URLs are dealt to `FOLDS` folds by a hash, and each fold is scored by models of the other folds only. So all
scores are held out. The cut is calibrated on the scores of URLs that no rule judges (counted in steps of `STEP`): of
those that put at most `WRONG` of the accepted on the wrong side, the one that parts the classes best. Verdicts follow
the score, not the label; `errors` counts where the two differ. Rules take precedence; the longest rule that fits wins.

Defined results: a null URL, or one without `://`, has empty host and path and is allowed (there is no evidence); if
either class is empty, all that no rule judges are allowed; a null page_id is kept; repeated rows are judged alike; an
empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _shared

ORDER = 4
BETA = 1.0
FOLDS = 4
#: Steps of the score in which the cut is sought, and the share of accepted examples that it may reject.
STEP = 0.001
WRONG = 0.005

# The rules of the registered query, (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

# Words whose presence in a host marks an example of a rejected URL.
SEEDS = ("adult", "bet", "bets", "betting", "bingo", "casino", "cams", "crack", "dating", "escort", "farm", "gambling", "jackpot", "loan", "loans", "lottery", "nude", "payday", "pills", "poker", "porn", "roulette", "sex", "slots", "spam", "torrent", "viagra", "warez", "win", "xxx")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first `://` up to `/`, `?`, `#` or the end; A-Z in lower case) and path (then up to `?`, `#` or the end)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def judge_by_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (`host` + `path`, else null) and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # later ones override
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def rejected_by_seeds(host: Column, seeds=SEEDS) -> Column:
    return F.arrays_overlap(F.split(host, "[.-]"), F.array(*[F.lit(s) for s in seeds]))


def _padded(text: Column) -> Column:
    return F.concat(F.lit("\u0002" * ORDER), F.lower(text), F.lit("\u0003"))


def _grams(texts: DataFrame) -> DataFrame:
    """Adds gram: each character of a text behind the ORDER characters before it."""
    s = F.col("s")
    places = F.sequence(F.lit(ORDER + 1), F.length(s))
    return texts.withColumn("s", _padded(F.col("text"))).withColumn("gram", F.explode(F.transform(places, lambda i: s.substr(i - ORDER, F.lit(ORDER + 1))))).drop("s", "text")


#: Counts of accepted and rejected examples by fold.
_COUNTS = [f"{k}{f}" for k in "ar" for f in range(FOLDS)]


def train(texts: DataFrame) -> DataFrame:
    """gram, ratios and n of (text, fold, rejected, n) rows.

    ratios has, for each fold, the log of the gram's last character's probability under the accepted model less that
    under the rejected one, both of the other folds' rows; n is how many texts' grams it is.
    """
    own = {f"{k}{f}": F.sum(F.when((F.col("rejected") == (k == "r")) & (F.col("fold") == f), F.col("n")).otherwise(0)) for k in "ar" for f in range(FOLDS)}
    counted = _grams(texts.select("text", "fold", "rejected", "n")).groupBy("gram").agg(*[v.alias(k) for k, v in own.items()], F.count("*").alias("seen"))
    tables = [_shared.written(counted, "urlgrams")]
    sums = [F.sum(k).alias(k) for k in _COUNTS]
    for order in range(ORDER, 0, -1):  # from each order's grams those without their first character
        tables.append(_shared.written(tables[-1].groupBy(F.substring("gram", 2, order).alias("gram")).agg(*sums), "urlgrams"))
    tables = tables[::-1]  # by order: grams of order + 1 characters
    p = None
    for order, table in enumerate(tables):
        table = table.withColumn("context", F.substring("gram", 1, order))
        contexts = table.groupBy("context").agg(*[F.sum(k).alias(f"c_{k}") for k in _COUNTS])
        whole = _shared.with_small(table, contexts, ["context"])
        if p is not None:
            whole = _shared.with_small(whole.withColumn("tail", F.substring("gram", 2, order)), p, ["tail"])
        made = {}
        for k in "ar":
            for f in range(FOLDS):
                seen, context = (sum((F.col(f"{c}{k}{g}") for g in range(FOLDS) if g != f), F.lit(0)) for c in ("", "c_"))
                made[f"p_{k}{f}"] = (seen + BETA * (F.lit(1 / 256) if p is None else F.col(f"p_{k}{f}"))) / (context + BETA)
        kept = [F.col("seen")] if order == ORDER else []
        p = _shared.written(whole.select(F.col("gram").alias("tail"), *kept, *[v.alias(k) for k, v in made.items()]), "urlp")
    ratios = F.array(*[F.log(f"p_a{f}") - F.log(f"p_r{f}") for f in range(FOLDS)])
    return p.select(F.col("tail").alias("gram"), ratios.alias("ratios"), F.col("seen").alias("n"))


def _cut(free: DataFrame) -> float | None:
    """The cut of held-out scores; null without examples of both classes, or if no cut parts them."""
    steps = free.groupBy(F.floor(F.col("score") / STEP).alias("step")).agg(F.count_if(~F.col("rejected")).alias("a"), F.count_if("rejected").alias("r"))
    below = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as steps: a score is within a few dozen
    shares = [(F.coalesce(F.sum(k).over(below), F.lit(0)) / F.nullif(F.sum(k).over(Window.partitionBy()), F.lit(0))).alias(k) for k in "ar"]
    best = steps.select("step", *shares).where((F.col("a") <= WRONG) & (F.col("r") > F.col("a"))).orderBy(F.desc(F.col("r") - F.col("a")), "step").select("step").first()
    return None if best is None else best["step"] * STEP


def judge(pages: DataFrame, rules=RULES, seeds=SEEDS) -> DataFrame:
    """page_id, host, path, rule, verdict, score (null without text), rejected (the label), cut of every (page_id, url) row."""
    host, path = split_url(F.col("url").cast("string"))
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = judge_by_rules(F.col("host"), F.col("path"), rules)
    parsed = parsed.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), F.concat("host", "path").alias("text"))
    label = F.coalesce(F.col("ruled") == "block", rejected_by_seeds(F.col("host"), seeds))
    parsed = _shared.written(parsed.withColumn("rejected", label), "urls")
    # The host goes with the text: where one ends and the other begins isn't in it.
    texts = parsed.where("text <> ''").groupBy("text", "host", "rejected").agg(F.count("*").alias("n"))
    fold = F.pmod(F.xxhash64(F.lit("fold"), "text"), F.lit(FOLDS)).cast("int")
    texts = _shared.written(texts.withColumn("fold", fold).withColumn("id", F.monotonically_increasing_id()), "urltexts")
    model = _shared.written(train(texts), "urlmodel")
    scored = _shared.left_join(_grams(texts.select("id", "fold", "text")), model, "gram", "n")
    scores = scored.groupBy("id").agg(F.avg(F.get("ratios", F.col("fold"))).alias("score"))
    scores = _shared.written(texts.join(scores, "id").groupBy("text").agg(F.sum("n").alias("n"), F.avg("score").alias("score")), "urlscores")
    scored = _shared.written(_shared.left_join(parsed, scores, "text", "n"), "urlscored")
    cut = F.lit(_cut(scored.where("rule is null and score is not null"))).cast("double")
    by_model = F.when(F.coalesce(F.col("score") < cut, F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "score", "rejected", cut.alias("cut"))


def errors(judged: DataFrame) -> DataFrame:
    """One row over `judge`'s rows without a rule: how many of either label, and how many of them the held-out score puts on the other side."""
    free = judged.where("rule is null and score is not null")
    blocked = F.col("verdict") == "block"
    return free.agg(*[F.count_if(c).alias(n) for n, c in (("accepted", ~F.col("rejected")), ("accepted_blocked", ~F.col("rejected") & blocked), ("rejected", F.col("rejected")), ("rejected_allowed", F.col("rejected") & ~blocked))])


def op9_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_shared.table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")
