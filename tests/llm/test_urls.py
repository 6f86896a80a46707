from __future__ import annotations

import math
import random
import re
import time
from collections import Counter

import pytest

from quillsift.llm.urls import LONGEST, SEEDS, best_split, corpus_words, segmented, url_scores


def all_splits(part, counts, total):
    """Every split, scored and compared from the last word on."""
    def lp(w):
        n = counts.get(w, 0)
        return math.log(n / (total + 1)) if n else -math.log(total + 1) - (len(w) - 1) * math.log(10)

    best = None
    for cut in range(1 << (len(part) - 1)):
        words, at = [], 0
        for i in range(1, len(part) + 1):
            if i == len(part) or cut >> (i - 1) & 1:
                words.append(part[at:i])
                at = i
        if all(len(w) <= LONGEST for w in words):
            key = (round(sum(map(lp, words)), 7), [len(w) for w in words[::-1]])
            if best is None or key > best[0]:
                best = (key, words)
    return best[1]


def test_segmentation_against_all_splits(spark):
    r = random.Random(1)
    vocab = Counter({"spam": 40, "farm": 30, "free": 80, "bets": 12, "be": 200, "a": 500, "th": 90, "the": 900, "there": 60, "re": 40, "ree": 2, "casino": 9, "win": 20})
    parts = {"spamfarm", "freebets", "casinowin", "therethe", "zzqx", "a", "thea"} | {"".join(r.choice(list(vocab) + ["q"]) for _ in range(3))[:13] for _ in range(60)}
    counts = spark.createDataFrame(list(vocab.items()), "word string, n long")
    got = {x.part: x.words for x in segmented(spark.createDataFrame([(p,) for p in parts], "part string"), counts, sum(vocab.values())).collect()}
    assert got == {p: all_splits(p, vocab, sum(vocab.values())) for p in parts}
    assert got["spamfarm"] == ["spam", "farm"] and got["freebets"] == ["free", "bets"]


def docs(spark):
    text = "the spam farm free bets casino win news of the day garden house " * 5
    return spark.createDataFrame([(1, text), (2, None), (3, ""), (1, text)], "doc_id long, text string")


def test_scores_against_naive_bayes(spark):
    urls = [f"http://www.{h}.example.com/{p}" for h, p in [("spamfarm", "win/9"), ("newsgarden", "day/1"), ("house", "day"), ("freebets", "win/7?ref=1"), ("housenews", "garden/3"), ("casino", ""), ("day", "win")]]
    rows = [(i, u, "c") for i, u in enumerate(urls)] + [(0, urls[0], "c"), (None, urls[1], "c")]
    out = url_scores(spark.createDataFrame(rows, "page_id long, url string, host string"), docs(spark)).collect()
    assert len(out) == len(rows)
    words = {r.host: r.host_words for r in out}
    assert words["www.spamfarm.example.com"] == ["www", "spam", "farm", "example", "com"]
    toks = [[f"h:{w}" for w in words[re.sub(r"^http://|/.*$", "", u)]] + [f"p:{t}" for t in re.findall(r"[a-z]+|#", re.sub(r"\d+", "/#/", re.sub(r"^http://[^/]*", "", u)))] for _, u, _ in rows]
    bad = [any(t[2:] in SEEDS for t in ts if t[:2] == "h:") for ts in toks]
    count = {c: Counter(t for ts, b in zip(toks, bad) if b == c for t in ts) for c in (False, True)}
    vocab = set(count[False]) | set(count[True])
    def score(ts):
        s = math.log(bad.count(False)) - math.log(bad.count(True))
        for t in ts:
            s += math.log((count[False][t] + 1) / (sum(count[False].values()) + len(vocab))) - math.log((count[True][t] + 1) / (sum(count[True].values()) + len(vocab)))
        return s
    want = sorted((str(r[0]), round(score(t), 5)) for r, t in zip(rows, toks))
    for (i, s), (j, t) in zip(want, sorted((str(r.page_id), round(r.score, 5)) for r in out)):
        assert i == j and s == pytest.approx(t, abs=2e-5)
    kept = {r.page_id: r.keep for r in out}
    assert not kept[0] and not kept[3] and kept[1] and kept[4]


def test_odd_urls(spark):
    rows = [(1, None), (2, ""), (3, "not a url"), (4, "http://"), (5, "HTTP://User:pw@SPAM-Farm.Example.COM:80/A?b#c"), (6, "//x.org"), (7, "https://" + "a" * 60 + ".com/" + "p/" * 20_000), (7, "ftp://1.2.3.4/"), (None, "http://größe.de/ü")]
    d = spark.createDataFrame([(*r, "c", 0) for r in rows], "page_id long, url string, tokens string, n int")
    out = url_scores(d, docs(spark)).collect()
    assert len(out) == len(rows) and all(r.score is not None for r in out)
    by = {r.page_id: r for r in out}
    assert by[5].host == "spam-farm.example.com" and by[1].host == by[3].host == by[4].host == ""
    assert by[1].host_words == []
    one = url_scores(d.where("page_id <> 5"), docs(spark)).collect()
    assert all(r.score is None and r.keep for r in one)
    assert url_scores(d.limit(0), docs(spark)).count() == 0
    assert url_scores(d, docs(spark).limit(0)).count() == len(rows)
    assert corpus_words(docs(spark)).where("word = 'the'").first().n == 20


def test_unwanted_hosts_of_any_words(spark):
    """Hosts of other words than those of the test tables, run together, without a seed word in any document."""
    text = "night videos online buy free best news of the garden house reads threads heads specialist essex alphabet spills " * 200
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    ill = ["www.porn-videos.net", "xxx.com", "xxxvideos.com", "pokernight.org", "onlinepoker.org", "buyviagra.com", "viagra24.de", "phishing-host.io", "pornhub.com", "zqgambling.com", "freetorrents.net", "bestescorts.co.uk"]
    good = ["news.garden.org", "threads.net", "reads.org", "heads.com", "specialist.de", "essex.ac.uk", "alphabet.com", "spills.org", "housenews.com", "zqqx.com"] * 2
    rows = [(i, f"https://{h}/{i % 3}") for i, h in enumerate(ill + good)]
    out = {r.page_id: r for r in url_scores(spark.createDataFrame(rows, "page_id long, url string"), d).collect()}
    assert len(out) == len(rows) and all(r.score is not None for r in out.values())
    for i, (_, h) in enumerate(rows):
        assert bool(set(out[i].host_words) & set(SEEDS)) == (i < len(ill)), (h, out[i].host_words)
    assert not any(out[i].keep for i in range(len(ill)))
    assert all(out[i].keep for i in range(len(ill), len(rows)))


def test_a_very_long_host():
    began = time.perf_counter()
    words = best_split("spamfarm" * 12_500 + "z", {"spam": -5.0, "farm": -5.0}, -14.0, math.log(10))
    assert words[-1] == "z" and words[:-1] == ["spam", "farm"] * 12_500
    assert time.perf_counter() - began < 30


def test_long_hosts_in_a_table(spark):
    rows = [(1, "http://" + "spamfarm" * 1000 + ".com/a"), (2, "http://news.org/b"), (3, "http://" + "q" * 50 + ".org")]
    out = {r.page_id: r for r in url_scores(spark.createDataFrame(rows, "page_id long, url string"), docs(spark)).collect()}
    assert out[1].host_words == ["spam", "farm"] * 1000 + ["com"] and out[3].host_words == ["q" * 50, "org"]


def test_given_labels_and_hosts_held_out(spark):
    """Hosts of words that no seed names; half of the hosts are labelled, the others are judged by their words."""
    r = random.Random(3)
    ill, good = ["zork", "blarg", "quux", "frob"], ["house", "garden", "news", "day"]
    hosts = sorted({(f"{r.choice(ws)}{r.choice(ws)}{r.choice(['the', 'of', ''])}.{r.choice(['com', 'org'])}", ws is ill) for ws in (ill, good) for _ in range(60)})
    rows = [(i, f"http://{h}/{r.choice(['a', 'b'])}/{i}") for i, (h, _) in enumerate(hosts)]
    d = spark.createDataFrame([(1, "zork blarg quux frob house garden news day the of " * 20)], "doc_id long, text string")
    known = spark.createDataFrame(hosts[::2], "host string, bad boolean")
    out = url_scores(spark.createDataFrame(rows, "page_id long, url string"), d, labels=known).collect()
    held = [(x.keep, hosts[x.page_id][1]) for x in out if x.page_id % 2]
    assert len(out) == len(rows) and len(held) > 20
    assert sum(keep != bad for keep, bad in held) >= 0.95 * len(held)
    assert all(x.keep for x in url_scores(spark.createDataFrame(rows, "page_id long, url string"), d).collect())
