"""Filter audit, prefix trie and URL models against plain Python, with the odd cases."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from docquarry.llm.filteraudit import filter_audit
from docquarry.llm.prefixtrie import conversation_trie
from docquarry.llm.registry import URL_RULES, op11_url_filter
from docquarry.llm.urlmodel import ALPHABET, BINS, END, FOLDS, OTHER, START, Rule, judge_urls
from tests.llm.fixture import corpus, words

DOCS = corpus()


# filter audit

def plain_audit(docs, labels):
    """docs: (id, text, lang)."""
    least, out = {}, {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good, toxic = ({i for i, q, x in labels if (q, x)[k] == 1 and i is not None} for k in (0, 1))
    judged = collections.defaultdict(list)
    for i, t, lang in docs:
        t = t or ""
        w = words(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        judged[lang or ""].append((i, {k for k, v in fails.items() if v}))
    for part, rows in judged.items():
        shapley = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone, kept = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(kept), len(gone), sum(f in r[1] for r in rows) - len(gone), sum(r[1] == {f} for r in rows), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)]
                left = kept
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def run_audit(spark, docs, labels):
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, lang string, filter string, row int").repartition(5)
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
            for r in filter_audit(df, lab).collect()}


def test_filter_audit(spark):
    rnd = random.Random(1)
    docs = [(i, t if rnd.random() < 0.6 or t is None else t.upper() + " #%", rnd.choice(["en", "de", None, ""])) for i, t in DOCS]
    docs += [(None, docs[3][1], "en"), (None, None, "xx"), docs[5], docs[5], (docs[6][0], "A text of its own under a shared id", "en")]
    docs += [(i, " ".join(f"w{j}" for j in range(i % 7, 150 + i % 9)), "fr") for i in range(5000, 5040)]
    labels = [(i, rnd.randrange(2), rnd.randrange(2)) for i, _, _ in docs] + [(docs[0][0], 1, 1), (None, 1, 1), (docs[1][0], None, None)]
    got, want = run_audit(spark, docs, labels), plain_audit(docs, labels)
    assert got == want and len(got) == 600 * len({d[2] or "" for d in docs})


def test_filter_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit(docs, labels).count() == 0
    assert run_audit(spark, [(1, None, None)], [])["", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120]


# prefix trie

def plain_trie(turns, head, base):
    told = collections.defaultdict(list)
    for c, n, role, text in turns:
        if c is not None:
            told[c].append((n is not None, n or 0, role or "", text or ""))
    told = {c: [t[2:] for t in sorted(v)] for c, v in told.items()}
    made = {c: tuple(told.get(base(c), [])[: head(c)] + v[head(c):]) for c, v in told.items()}
    members = collections.defaultdict(list)
    for c, v in made.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if made[c] == p).encode()).hexdigest()) for p, m in members.items())


def run_trie(spark, turns, limit, **more):
    df = spark.createDataFrame([(*t, 7, "x") for t in turns], "conv_id bigint, turn int, role string, text string, pos int, key string").repartition(4)
    rows = conversation_trie(df, limit=limit, **more).collect()
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"],
                   r["ends_sha256"]) for r in rows)


def some_turns(seed):
    rnd = random.Random(seed)
    turns = []
    for c in range(-3, 60):
        for n in range(rnd.randrange(1, 7)):
            turns.append((c * 7, n, rnd.choice(["user", "bot"]), rnd.choice(["hi", "yes", "no", "日本語", None])))
    return turns


@pytest.mark.parametrize("limit", [8, 1 << 15])
def test_prefix_trie(spark, limit):
    turns = some_turns(2)
    turns += [(1000 + c, n, "user", "same") for c in range(40) for n in range(5)]  # a conversation told forty times
    turns += [(2000, n, None, f"turn {n}") for n in range(90)]  # a chain
    turns += [(3, None, "user", "b"), (3, None, "user", "a"), (3, 1, None, None), (3, 1, None, None), (None, 1, "user", "lost"), (4, 2, "user", "x" * 20_000)]
    rule = {"head": lambda c: F.pmod(c, F.lit(6)), "base": lambda c: c - c % 100, "most": 5}
    assert run_trie(spark, turns, limit, **rule) == plain_trie(turns, lambda c: c % 6, lambda c: c - int(math.fmod(c, 100)))


def test_prefix_trie_without_a_rule_and_of_nothing(spark):
    turns = some_turns(5)
    assert run_trie(spark, turns, 1 << 15) == plain_trie(turns, lambda c: 0, lambda c: c)
    assert run_trie(spark, [], 8) == [] == run_trie(spark, [(None, 1, "user", "lost")], 8)


def test_prefix_trie_of_turnless_conversations(spark):
    turns = [(107, 1, "user", "only"), (205, 1, "user", "a"), (200, 1, "user", "b")]  # 100 is absent, so 107 loses its turn
    rule = {"head": lambda c: F.lit(2), "base": lambda c: c - c % 100, "most": 2}
    assert run_trie(spark, turns, 1 << 15, **rule) == plain_trie(turns, lambda c: 2, lambda c: c - c % 100)


# URL models

def fits(url, rules):
    m = re.search("://([^/?#]*)([^?#]*)", url or "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    found = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, min(found, key=lambda r: (-len(r.host + r.path), r.host + r.path), default=None)


def folded(url):
    return "".join(c if c in ALPHABET[:-2] else OTHER for c in ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url or "")))


def plain_scores(urls, aside, rules, order, share, prior):
    """(host, path, rule, score, verdict) of each URL."""
    judged = [fits(u, rules) for u in urls]
    counts = ({}, {})
    total = collections.Counter()
    for u, a, (_, _, rule) in zip(urls, aside, judged):
        if rule and not a:
            text = START * order + folded(u) + END
            for i in range(order, len(text)):
                for n in range(order + 1):
                    counts[rule.verdict == "allow"].setdefault(text[i - n : i], collections.Counter())[text[i]] += 1
                    total[text[i - n : i]] += 1
    everything = total[""]
    kept = {c for c, n in total.items() if n * share > everything} | {""}

    def chance(table, context, char):
        below = chance(table, context[1:], char) if context else 1 / len(ALPHABET)
        own = table.get(context, {})
        return (own.get(char, 0) + prior * below) / (sum(own.values()) + prior)

    def score(u):
        text = START * order + folded(u) + END
        gains = 0.0
        for i in range(order, len(text)):
            context = next(text[i - n : i] for n in range(order, -1, -1) if text[i - n : i] in kept)
            gains += math.log(chance(counts[True], context, text[i])) - math.log(chance(counts[False], context, text[i]))
        return gains / (len(text) - order)

    scores = [score(u) for u in urls]
    held = [(math.floor(s * BINS), r.verdict == "allow") for s, a, (_, _, r) in zip(scores, aside, judged) if a and r]
    n = collections.Counter(x for _, x in held)
    bound = 0
    if n[True] and n[False]:
        gap = {e: round(sum(b >= e and x for b, x in held) / n[True] - sum(b >= e and not x for b, x in held) / n[False], 9) for e, _ in held}
        bound = min(gap, key=lambda e: (-gap[e], abs(e), e))
    return [(h, p, r and r.host + r.path, s, r.verdict if r else "allow" if math.floor(s * BINS) >= bound else "block", bound) for (h, p, r), s in zip(judged, scores)]


def test_url_models(spark):
    rnd = random.Random(4)
    urls = [f"http{rnd.choice(['', 's'])}://{rnd.choice(['a', 'www', 'Blog', 'x.y'])}.{rnd.choice(['one', 'two', 'EXAMPLE', 'three'])}.{rnd.choice(['org', 'com', 'net'])}"
            f"{rnd.choice(['/en/', '/es/', '/fr/', '/de/', ''])}{rnd.choice(['', '1', '29', 'x?q=/de/', '#top', 'é日'])}" for _ in range(300)]
    urls += [None, "", "no scheme", "://", "http://org", "HTTP://EXAMPLE.ORG/ES/", "x://y://z.org/fr/", "http://a.com/fr/" + "long" * 3000, urls[0], urls[0]]
    df = spark.createDataFrame([(i, u, "old", 1.5) for i, u in enumerate(urls)], "page_id bigint, url string, host string, score double").repartition(3)
    aside = {r["page_id"]: r["a"] for r in df.select("page_id", (F.pmod(F.xxhash64(F.coalesce("url", F.lit(""))), F.lit(FOLDS)) == 0).alias("a")).collect()}
    got = {r["page_id"]: r for r in judge_urls(df, URL_RULES, order=3, share=20, prior=2.0).collect()}
    want = plain_scores(urls, [aside[i] for i in range(len(urls))], URL_RULES, 3, 20, 2.0)
    assert len(got) == len(urls)
    for i, (host, path, rule, score, verdict, bound) in enumerate(want):
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["score"] == pytest.approx(score, abs=1e-5)
        if abs(score * BINS - round(score * BINS)) > 1e-3:
            assert r["verdict"] == verdict
    assert {r["verdict"] for r in got.values() if r["rule"] is None} == {"allow", "block"}


def test_url_models_without_examples(spark):
    df = spark.createDataFrame([(1, "http://a.net/"), (2, "http://a.org/x"), (3, None)], "page_id bigint, url string")
    assert {r["verdict"] for r in judge_urls(df, URL_RULES).collect()} == {"allow"}
    assert [r["verdict"] for r in judge_urls(df, [Rule("block", "", "")]).orderBy("page_id").collect()] == ["allow", "allow", "block"]
    assert judge_urls(df.limit(0), URL_RULES).count() == 0


def test_registered_url_query_tells_the_rules_examples_apart(spark):
    rows = op11_url_filter(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 250
    ruled = [r for r in rows if r["rule"]]
    high = [r["score"] for r in ruled if r["verdict"] == "allow"]
    low = [r["score"] for r in ruled if r["verdict"] == "block"]
    assert sum(a > b for a in high for b in low) > 0.9 * len(high) * len(low)
