"""Operator 8, URL filter: host names are split into words by unigram Viterbi; naive Bayes scores the words."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import join_hot, written

#: Longest word that a host name is split into: a label of a host has no more letters (RFC 1035), so longer words of
#: documents cannot stand in one. Should a malformed host have a longer label, it is split into words up to this length.
LONGEST = 63
#: Host words that mark a host as unwanted in training where no labels are given, by the usual classes of block lists:
#: gambling, adult, drugs, fraud and piracy, advertising. Words that are common within others are left out. They are
#: features as well, so for hosts that hold one the score says little more than this list; what naive Bayes adds is the
#: weight of the words and paths that go with them.
SEEDS = tuple(
    "casino casinos bet bets betting gamble gambling poker slots jackpot roulette blackjack baccarat lottery lotto sportsbook bookmaker bookmakers wager wagering "
    "adult adults porn porno pornography xxx sex sexy sexcam sexcams nude nudes naked nsfw erotic erotica erotik hentai milfs fetish escort escorts camgirl camgirls hookup hookups strippers bdsm "
    "pills viagra cialis levitra xanax tramadol valium vicodin ambien oxycodone phentermine steroids "
    "spam spammer spammers phish phishing malware spyware adware ransomware botnet scam scams payday replicas warez keygen keygens torrents pirated nulled "
    "ads adserver adservers advert adverts advertising popup popups popunder popunders clickbait".split()
)
#: Share of all words that the segmenter takes a seed of more than three letters to have at least: documents for training
#: may hold none, and one that is as rare as any unknown word would not be split off unknown letters.
SEED_SHARE = 1e-3


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dots; '' for null or a URL without one."""
    h = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#\s]*)", 1)
    return F.regexp_replace(F.regexp_replace(h, r"^.*@", ""), r"(:[0-9]*)?\.*$", "")


def path_tokens(url: Column) -> Column:
    """Tokens of path, query and fragment: runs of letters, and '#' for each run of digits, lower case."""
    rest = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^\s*([a-z][a-z0-9+.\-]*:)?//[^/?#\s]*", "")
    return F.regexp_extract_all(F.regexp_replace(rest, r"[0-9]+", "/#/"), F.lit(r"[a-z]+|#"), 0)


def host_parts(host: Column) -> Column:
    """Runs of letters of a host; digits, hyphens and dots part them."""
    return F.regexp_extract_all(host, F.lit(r"[a-z]+"), 0)


def corpus_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents: lower-case runs of ASCII letters; longer ones than LONGEST can be no host word."""
    w = docs.select(F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("word"))
    return w.where((F.length("word") > 0) & (F.length("word") <= LONGEST)).groupBy("word").agg(F.count("*").alias("n"))


def with_seeds(counts: DataFrame, seeds: tuple[str, ...], total: int) -> DataFrame:
    """counts with every seed as a word: seen once at least, one of more than three letters SEED_SHARE of total times."""
    if not seeds:
        return counts
    seen = {r.word: r.n for r in counts.where(F.col("word").isin(*seeds)).collect()}
    rows = [(w, max(seen.get(w, 0), 1, math.ceil(total * SEED_SHARE) if len(w) > 3 else 1)) for w in sorted(set(seeds))]
    return counts.where(~F.col("word").isin(*seeds)).unionByName(counts.sparkSession.createDataFrame(rows, "word string, n long"))


def best_split(part: str, known: dict[str, float], floor: float, letter: float) -> list[str]:
    """The split of a part that segmented() describes, by back pointers: linear in the length of the part."""
    n = len(part)
    score, back = [0.0] * (n + 1), [0] * (n + 1)
    unknown = [floor - k * letter for k in range(LONGEST)]
    for end in range(1, n + 1):
        best = None
        for k in range(1, min(end, LONGEST) + 1):
            lp = known.get(part[end - k : end])
            found = round(score[end - k] + (unknown[k - 1] if lp is None else lp), 9)
            if best is None or found >= best:
                best, back[end] = found, k
        score[end] = best
    words = []
    while n:
        words.append(part[n - back[n] : n])
        n -= back[n]
    return words[::-1]


def segmented(parts: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(part, words): the split of each distinct part into words of the highest product of unigram probabilities.

    A word seen n > 0 times has probability n / (total + 1); an unseen one of k letters 1 / (total + 1) / 10 ** (k - 1):
    unknown letters run together rather than fall apart into chance words. Of equal splits the one whose last word is
    the longest stays, and so on towards the front. The substrings of the parts are joined to the counts, so that the
    vocabulary is never sent about; a part's own table then decides its split. With words in counts that are single
    letters, unknown letters do fall apart into them.
    """
    p = written(parts.select("part").distinct().withColumn("no", F.monotonically_increasing_id()), "host-parts")
    # at each letter, that letter and what follows, as far as a word can go
    ahead = p.select("no", F.explode(F.regexp_extract_all("part", F.lit(f"(?=([a-z]{{1,{LONGEST}}}))"), 1)).alias("ahead")).distinct()
    subs = ahead.select("no", F.explode(F.transform(F.sequence(F.lit(1), F.length("ahead")), lambda k: F.substring(F.col("ahead"), F.lit(1), k))).alias("word")).distinct()
    lp = F.log(F.col("n") / F.lit(total + 1.0)).alias("lp")
    needed = written(subs.groupBy("word").agg(F.count("*").alias("uses")).join(counts, "word").select("word", "uses", lp), "host-substrings")
    known = join_hot(subs, needed, "word", "uses").where("lp is not null").groupBy("no").agg(F.map_from_entries(F.collect_list(F.struct("word", "lp"))).alias("known"))
    floor, letter = math.log(1 / (total + 1)), math.log(10)

    @F.pandas_udf("array<string>")
    def split(part: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([best_split(t, dict(k) if k is not None else {}, floor, letter) for t, k in zip(part, known)], dtype=object)

    return p.join(known, "no", "left").select("part", split("part", "known").alias("words"))


def url_scores(pages: DataFrame, docs: DataFrame, labels: DataFrame | None = None, seeds: tuple[str, ...] = SEEDS, smoothing: float = 1.0, threshold: float = 0.0) -> DataFrame:
    """Operator 8. One row for each row of pages (page_id, url): page_id, host, host_words, score, keep.

    labels (host, bad) names hosts known to be unwanted or wanted, once each: the URLs of those are what naive Bayes is
    trained on. Without labels every URL is: a host counts as unwanted if one of its words is in seeds, which the
    segmenter knows whether documents hold them or not. Multinomial naive Bayes over the tokens of URLs (host words
    marked 'h:', path tokens 'p:') gives score, the log odds of wanted to unwanted, rounded to 6 digits; keep is
    score >= threshold. Tokens not seen in training count for nothing. Null and malformed URLs have host '' and the score
    of the priors. Without URLs of one of the classes score is null and keep true. Repeated rows all count. Words of a
    host have at most LONGEST letters.
    """
    u = pages.select("page_id", host_of(F.col("url")).alias("host"), path_tokens(F.col("url")).alias("path"))
    u = written(u, "urls")
    counts = written(corpus_words(docs), "word-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hosts = u.groupBy("host").agg(F.count("*").alias("n"))
    parts = hosts.select("host", "n", F.posexplode_outer(host_parts(F.col("host"))).alias("at", "part"))
    seg = segmented(parts.where("part is not null"), with_seeds(counts, seeds, total), total)
    words = parts.join(seg, "part", "left").groupBy("host").agg(F.first("n").alias("n"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "words"))), lambda x: F.coalesce(x["words"], F.array().cast("array<string>")))).alias("host_words"))
    if labels is None:
        words = words.withColumn("bad", F.arrays_overlap("host_words", F.array(*map(F.lit, seeds))))
    else:
        words = words.join(labels.select("host", F.col("bad").cast("boolean").alias("bad")), "host", "left")
    words = written(words, "host-words")

    rows = join_hot(u, words, "host", "n")
    tokens = F.concat(F.transform("host_words", lambda w: F.concat(F.lit("h:"), w)), F.transform("path", lambda w: F.concat(F.lit("p:"), w)))
    rows = written(rows.select("page_id", "host", "host_words", "bad", tokens.alias("tokens")), "url-tokens")
    n = {b: c for b, c in rows.where("bad is not null").groupBy("bad").count().collect()}
    if len(n) < 2:
        return rows.select("page_id", "host", "host_words", F.lit(None).cast("double").alias("score"), F.lit(True).alias("keep"))
    taught = rows.where("bad is not null")
    by_token = taught.select("bad", F.explode("tokens").alias("token")).groupBy("token").agg(F.count_if(~F.col("bad")).alias("good"), F.count_if("bad").alias("ill"))
    by_token = written(by_token, "token-counts")
    v, good, ill = by_token.agg(F.count("*"), F.sum("good"), F.sum("ill")).first()
    odds = F.log((F.col("good") + smoothing) / F.lit(good + smoothing * v)) - F.log((F.col("ill") + smoothing) / F.lit(ill + smoothing * v))
    prior = F.log(F.lit(float(n[False]))) - F.log(F.lit(float(n[True])))
    # equal token lists are scored once, each known by a number: URLs repeat their shapes
    lists = written(rows.groupBy("tokens").agg(F.count("*").alias("n")).withColumn("no", F.monotonically_increasing_id()), "token-lists")
    used = lists.select("no", F.explode("tokens").alias("token"))
    weights = written(used.groupBy("token").agg(F.count("*").alias("uses")).join(by_token.select("token", odds.alias("w")), "token"), "token-weights")
    sums = join_hot(used, weights, "token", "uses").groupBy("no").agg(F.sum("w").alias("w"))
    scored = written(lists.join(sums, "no", "left").select("tokens", "n", F.round(prior + F.coalesce("w", F.lit(0.0)), 6).alias("score")), "list-scores")
    out = join_hot(rows, scored, "tokens", "n")
    return out.select("page_id", "host", "host_words", "score", (F.col("score") >= threshold).alias("keep"))
