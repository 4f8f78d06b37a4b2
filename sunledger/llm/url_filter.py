"""URL filters: host word segmentation by unigram Viterbi, then multinomial naive Bayes.

Rules decide first. What no rule fits is scored: the labels of the host are split into words
of a unigram model (counts of the words in all page titles), path parts are split likewise,
and a multinomial naive Bayes model over these tokens, learned from every URL that a rule
decides, gives block or allow.

Both models stay distributed, with every word and token: counts are joined to the distinct
candidate words, runs and tokens of each block of about BLOCK_ROWS rows.

Defined cases: null URLs and URLs without :// have empty host and path, fit no rule and are
allowed; without blocked or without allowed examples everything that no rule fits is allowed;
equal log odds allow; repeated rows get equal results; null ids are kept; a very long URL costs its length
times the number of lengths that words have; other columns of the input are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunledger.llm.common import materialize

#: Rows that a task looks words or tokens up for at a time.
BLOCK_ROWS = 20_000
RUN = re.compile(r"[0-9]+|[^\W\d_]+")


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as it is written, and its action; rules are (action, host/path)."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # later ones win
        at, _, start = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + start)
        name, action = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(act)).otherwise(action)
    return name, action


def word_counts(titles: DataFrame) -> tuple[DataFrame, int]:
    """Count of each word of two letters or more of column title, and of all."""
    words = materialize(titles.select(F.explode(F.regexp_extract_all(F.lower("title"), F.lit(r"\p{L}{2,}"), F.lit(0))).alias("word")).groupBy("word").count(), "title-words")
    return words, words.agg(F.sum("count")).first()[0] or 0


def split_words(name: str, model: dict[str, float], lengths: list[int]) -> list[str]:
    """Most probable split of a run of letters into words; unknown words cost more with each letter, and may be as long as the run.

    lengths: those that known words have. Of equal splits the one with the longest last word counts.
    """
    unknown = 1 - math.log10(model[""])
    best: list[tuple[float, int]] = [(0.0, 0)]
    open_ = (0.0, 0)  # the start that is best for an unknown word that ends here or later
    for end in range(1, len(name) + 1):
        found = (open_[0] + unknown - end, open_[1])
        for n in lengths:
            if n <= end and (p := model.get(name[end - n : end])) is not None:
                found = max(found, (best[end - n][0] + p, end - n), key=lambda x: (x[0], -x[1]))
        best.append(found)
        open_ = max(open_, (found[0] + end, end), key=lambda x: (x[0], -x[1]))
    words, end = [], len(name)
    while end:
        start = best[end][1]
        words.append(name[start:end])
        end = start
    return words[::-1]


def parts_of(host: Column, path: Column) -> Column:
    """Host ending, and runs of letters (h: or p:) that are still to be split; numbers count by their length."""

    def runs(text: str, kind: str) -> list[str]:
        return [f"{kind}#{len(r)}" if r[0].isdigit() else kind + r for r in RUN.findall(text)]

    @F.pandas_udf("array<string>")
    def parts(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        labels = [h.split(".") if h else [] for h in hosts]
        return pd.Series([runs(" ".join(x[:-1]), "h:") + [f"e:{y}" for y in x[-1:]] + runs(p.lower(), "p:") for x, p in zip(labels, paths, strict=True)], dtype=object)

    return parts(host, path)


def is_run(part: str) -> bool:
    return part[:2] != "e:" and part[2] != "#"


def pieces(run: str, lengths: list[int]) -> list[str]:
    """Whatever could be a known word of a run."""
    return [run[i : i + n] for n in lengths for i in range(len(run) - n + 1)]


def look_up(rows: DataFrame, by: str, keys: Column, found: DataFrame, work: Callable[[pd.DataFrame, dict], pd.DataFrame], schema: str) -> DataFrame:
    """work on each block of rows, with the entries of found (key, value) that its keys need."""
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(by), F.lit(blocks)))
    wanted = rows.select("block", F.explode(keys).alias("key")).distinct().join(found, "key").select(F.col("block").alias("at"), "key", "value")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return work(left, dict(zip(right["key"], right["value"], strict=True)))

    return rows.groupBy("block").cogroup(wanted.groupBy("at")).applyInPandas(run, schema)


def tokens_of(urls: DataFrame, titles: DataFrame) -> DataFrame:
    """uid and tokens (host words, host ending, path words, numbers) of urls (uid, parts)."""
    words, total = word_counts(titles)
    size = float(max(total, 1))
    lengths = sorted(r["n"] for r in words.select(F.length("word").alias("n")).distinct().collect())  # lengths only
    runs = materialize(urls.select(F.explode("parts").alias("part")).filter("part not like 'e:%' and substring(part, 3, 1) <> '#'").select(F.substring("part", 3, 1 << 30).alias("run")).distinct(), "url-runs")

    @F.pandas_udf("array<string>")
    def candidates(names: pd.Series) -> pd.Series:
        return pd.Series([sorted(set(pieces(n, lengths))) for n in names], dtype=object)

    def split(left: pd.DataFrame, counts: dict) -> pd.DataFrame:
        model = {"": size, **{w: math.log10(n / size) for w, n in counts.items()}}
        return pd.DataFrame({"key": left["run"], "value": pd.Series([split_words(r, model, lengths) for r in left["run"]], index=left.index, dtype=object)})

    splits = materialize(look_up(runs, "run", candidates("run"), words.select(F.col("word").alias("key"), F.col("count").alias("value")), split, "key string, value array<string>"), "url-splits")

    def put(left: pd.DataFrame, known: dict) -> pd.DataFrame:
        rows = [[t for x in parts for t in ([x[:2] + w for w in known[x[2:]]] if is_run(x) else [x])] for parts in left["parts"]]
        return pd.DataFrame({"uid": left["uid"], "tokens": pd.Series(rows, index=left.index, dtype=object)})

    return look_up(urls.select("uid", "parts"), "uid", F.transform("parts", lambda x: F.substring(x, 3, 1 << 30)), splits, put, "uid long, tokens array<string>")


def token_odds(rows: DataFrame) -> tuple[float, DataFrame]:
    """Prior log odds of block, and each token's (key, value), from columns tokens and action (add-one smoothing)."""
    flag = F.col("action") == "block"
    n_block, n_allow = rows.agg(F.count_if(flag), F.count_if(~flag)).first()
    counts = materialize(rows.select(F.explode("tokens").alias("key"), flag.alias("flag")).groupBy("key").agg(F.count_if("flag").alias("block"), F.count_if(~F.col("flag")).alias("allow")), "url-tokens")
    block, allow, size = (x or 0 for x in counts.agg(F.sum("block"), F.sum("allow"), F.count("*")).first())
    value = F.log((F.col("block") + 1) / F.lit(float(block + size or 1))) - F.log((F.col("allow") + 1) / F.lit(float(allow + size or 1)))
    return math.log(n_block / n_allow) if n_block and n_allow else -math.inf, counts.select("key", value.alias("value"))


def judge(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Host, path, rule and verdict of each row of pages (page_id, url, html), and the tokens' log odds of block."""
    name, action = rule_of(F.col("host"), F.col("path"), rules)
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumns({"rule": name, "action": action})
    urls = materialize(urls.withColumns({"uid": F.monotonically_increasing_id(), "parts": parts_of(F.col("host"), F.col("path"))}), "urls")
    titles = pages.select(F.regexp_extract("html", r"(?is)<title[^>]*>([^<]*)<", 1).alias("title"))
    tokens = materialize(urls.drop("parts").join(tokens_of(urls, titles), "uid"), "tokens")
    prior, log = token_odds(tokens.filter(F.col("action").isNotNull()))

    def odds(left: pd.DataFrame, known: dict) -> pd.DataFrame:
        return pd.DataFrame({"uid": left["uid"], "log_odds": [prior + sum(known.get(t, 0.0) for t in row) if len(row) else -math.inf for row in left["tokens"]]})

    scored = tokens.join(look_up(tokens.select("uid", "tokens"), "uid", F.col("tokens"), log, odds, "uid long, log_odds double"), "uid")
    verdict = F.coalesce("action", F.when(F.col("log_odds") > 0, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "log_odds", "tokens")
