"""URL filter: rules first, then naive Bayes over segmented host names and path tokens.

Host names are often words written together. A unigram model counted over the titles, paths and hyphenated host names of all
pages, and over labels that several hosts share, splits each distinct name by Viterbi into its likeliest words. Hosts with a word of `SEED_WORDS` label their pages for a
multinomial naive Bayes over host words and path tokens, which then scores every page: words that go along with the seeds count
against a page too. A rule, where one fits, overrides the score.

Scale: unigrams, names and token weights are tables, joined by word; nothing that grows with the pages is broadcast. Names and
hosts are distinct before they are segmented or scored, and token counts combine on the map side. Path tokens that most pages
share find their weights by a bounded broadcast (`join_counted`). Rules are a short list, written into the plan.

Defined results: null urls and urls without :// have empty host and path, fit no rule and score the prior. Names of ASCII letters
are segmented whatever their length; numbers of a host count by their length, runs of other scripts as they are. Of rules of
equal length the first by code point wins. Repeated urls get equal verdicts. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.staging import join_counted, staged

#: The rules of the registered query.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: Words of unwanted host names that label the training pages.
SEED_WORDS = (
    "adult", "bets", "betting", "casino", "casinos", "cialis", "escort", "gambling", "hentai", "jackpot", "lottery", "malware",
    "nude", "payday", "phishing", "pills", "pharmacy", "poker", "porn", "slots", "spam", "torrent", "tracker", "track", "viagra",
    "warez", "xxx",
)
LONGEST_WORD = 20
#: A host label is a word of its own where at least so many hosts have it.
SHARED_LABEL = 5
SMOOTHING = 1.0
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]], value: int) -> Column:
    """Rule (value 0) or its verdict (value 1) of the longest rule that fits; null without one."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r[0]), r[0]), reverse=True):
        domain, slash, rest = rule[0].partition("/")
        fits = (host == domain) | F.endswith(host, F.lit(f".{domain}"))
        out = F.when(fits & F.startswith(path, F.lit(slash + rest)), F.lit(rule[value])).otherwise(out)
    return out


def best_split(name: str, counts: dict[str, int], total: int) -> list[str]:
    """Viterbi over the splits of a name; an unknown word of n letters has probability 10 / (total * 10**n)."""
    best, back = [0.0], [0]
    for end in range(1, len(name) + 1):
        choices = []
        for start in range(max(0, end - LONGEST_WORD), end):
            n = counts.get(name[start:end], 0)
            log = math.log(n / total) if n else math.log(10 / total) - (end - start) * math.log(10)
            choices.append((best[start] + log, -start))
        score, start = max(choices)
        best.append(score)
        back.append(-start)
    words, end = [], len(name)
    while end:
        words.append(name[back[end] : end])
        end = back[end]
    return words[::-1]


def unigrams(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """word, n: from titles, paths, host labels whose words a hyphen keeps apart, and labels that several hosts share."""
    title = F.lower(F.regexp_extract(F.col("html").cast("string"), r"(?is)<title[^>]*>(.*?)</title>", 1))

    def words(text: Column) -> Column:
        return F.explode(F.regexp_extract_all(text, F.lit("[a-z]+"), 0)).alias("word")

    labels = F.filter(F.split("host", r"\."), lambda x: F.contains(x, F.lit("-")))
    found = [
        pages.select(words(title)),
        urls.select(words(F.lower("path"))),
        urls.select(words(F.array_join(labels, "."))),
    ]
    hosts = urls.select("host").distinct()
    whole = hosts.select(F.explode(F.array_distinct(F.split("host", r"\."))).alias("word")).where(F.rlike("word", F.lit("^[a-z]+$")))
    shared = whole.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SHARED_LABEL)
    every = found[0].unionByName(found[1]).unionByName(found[2]).where(F.length("word").between(2, LONGEST_WORD))
    seeds = pages.sparkSession.createDataFrame([(w,) for w in SEED_WORDS], "word string")
    counted = every.unionByName(seeds).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    short = shared.where(F.length("word").between(2, LONGEST_WORD))
    return counted.unionByName(short).groupBy("word").agg(F.sum("n").alias("n"))


def segmented(names: DataFrame, words: DataFrame) -> DataFrame:
    """name -> words: every distinct name with the words of its likeliest split."""
    words = staged(words, "unigrams")
    total = max(1, int(words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))
    n = F.length("name")
    pieces = F.flatten(
        F.transform(
            F.sequence(F.lit(1), n),
            lambda i: F.transform(
                F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), n - i + 1)), lambda k: F.substring("name", i, k)
            ),
        )
    )
    parts = names.select("name", F.explode(F.array_distinct(pieces)).alias("word"))
    known = parts.join(words, "word").groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    @F.pandas_udf("array<string>")
    def split(name: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series(
            [best_split(x, {w["word"]: w["n"] for w in (k if k is not None else [])}, total) for x, k in zip(name, known, strict=True)]
        )

    return names.join(known, "name", "left").select("name", split("name", "known").alias("words"))


def host_words(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """host, words: the words of all names in the host, numbers by their length and runs of other scripts, in order."""
    runs = hosts.select("host", F.posexplode(_runs(F.col("host"))).alias("at", "name"))
    is_name = F.rlike("name", F.lit("^[a-z]"))
    names = staged(segmented(runs.where(is_name).select("name").distinct(), words), "names")
    others = runs.where(~is_name).select("host", "at", F.array(_plain(F.col("name"))).alias("words"))
    split = runs.where(is_name).join(names, "name").select("host", "at", "words").unionByName(others)
    joined = split.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("at", "words"))).alias("all"))
    return joined.select("host", F.flatten(F.transform("all", lambda x: x["words"])).alias("words"))


def _runs(text: Column) -> Column:
    """Letter runs, numbers, and runs of other scripts."""
    return F.regexp_extract_all(text, F.lit(r"[a-z]+|[0-9]+|[^\x00-\x7F]+"), 0)


def _plain(run: Column) -> Column:
    """A number counts by its length."""
    return F.when(F.rlike(run, F.lit("^[0-9]")), F.concat(F.lit("#"), F.length(run).cast("string"))).otherwise(run)


def _path_tokens(path: Column) -> Column:
    return F.transform(_runs(F.translate(path, _UPPER, _LOWER)), lambda x: F.concat(F.lit("p:"), _plain(x)))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score and the host's words. A positive score blocks where no rule fits."""
    url = F.col("url").cast("string")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path")
    )
    rows = staged(rows, "urls")
    hosts = staged(rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "hosts")
    words = host_words(hosts.select("host"), unigrams(pages, rows))
    known = F.coalesce("words", F.array().cast("array<string>"))
    listed = hosts.join(words, "host", "left").select("host", "pages", known.alias("words"))
    unwanted = F.arrays_overlap("words", F.array(*[F.lit(w) for w in SEED_WORDS]))
    listed = staged(listed.withColumn("unwanted", unwanted), "host_words")

    # Token counts of both classes; a host's tokens count once for each of its pages.
    by_host = listed.select(F.explode("words").alias("w"), "pages", "unwanted").select(
        F.concat(F.lit("h:"), "w").alias("token"), F.col("pages").alias("n"), "unwanted"
    )
    by_path = rows.select("host", F.explode(_path_tokens(F.col("path"))).alias("token"))
    by_path = by_path.groupBy("host", "token").agg(F.count(F.lit(1)).alias("n"))
    by_path = by_path.join(listed.select("host", "unwanted"), "host").select("token", "n", "unwanted")
    bad = F.sum(F.when(F.col("unwanted"), F.col("n")).otherwise(0))
    tokens = staged(
        by_host.unionByName(by_path).groupBy("token").agg(bad.alias("bad"), F.sum("n").alias("n")), "token_counts"
    )
    n_bad, n_all, n_tokens = tokens.agg(
        F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))
    ).first()
    pages_bad, pages_all = listed.agg(
        F.coalesce(F.sum(F.when(F.col("unwanted"), F.col("pages"))), F.lit(0)), F.coalesce(F.sum("pages"), F.lit(0))
    ).first()

    def log_share(n: Column, total: int) -> Column:
        return F.log((n + SMOOTHING) / (total + SMOOTHING * (n_tokens + 1)))

    weight = log_share(F.col("bad"), n_bad) - log_share(F.col("n") - F.col("bad"), n_all - n_bad)
    weights = staged(tokens.select("token", weight.alias("weight"), "n"), "token_weights")
    prior = math.log((pages_bad + SMOOTHING) / (pages_all - pages_bad + SMOOTHING))

    host_tokens = listed.select("host", F.explode("words").alias("w")).select("host", F.concat(F.lit("h:"), "w").alias("token"))
    host_scores = host_tokens.join(weights.drop("n"), "token").groupBy("host").agg(F.sum("weight").alias("host_score"))
    path_tokens = rows.select("path").distinct().select("path", F.explode(_path_tokens(F.col("path"))).alias("token"))
    path_tokens = staged(path_tokens, "path_tokens")
    path_scores = join_counted(path_tokens, weights, "token", "n", int(n_all)).groupBy("path").agg(F.sum("weight").alias("path_score"))
    host_side = staged(listed.join(host_scores, "host", "left").select("host", "words", "pages", "host_score"), "host_scores")

    scored = rows.join(path_scores, "path", "left")
    scored = join_counted(staged(scored, "path_scores"), host_side, "host", "pages", max(1, int(pages_all)), "left")
    score = F.lit(prior) + F.coalesce("host_score", F.lit(0.0)) + F.coalesce("path_score", F.lit(0.0))
    host, path = F.col("host"), F.col("path")
    verdict = F.coalesce(fitting_rule(host, path, rules, 1), F.when(score > 0, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select(
        "page_id", "host", "path", fitting_rule(host, path, rules, 0).alias("rule"), verdict.alias("verdict"), score.alias("score"), "words"
    )
