"""Rules found through the index against each rule by itself."""

import random
import re

import pytest
from pyspark.sql import functions as F

from trackscan import fixed_values as fixed
from trackscan.functions import match, rule_index


def test_needles_are_those_of_the_constant_form(spark):
    patterns = [*fixed.SCRIPT_PATTERNS, *(p for t in fixed.CATALOGUE for p in t[4])]
    patterns += ["", "a", "a.b", r"x\.y\(", r"long text.*short", r"a|b", r"(?:a)", r"a{2}", "[ab]cdef", r"\d+track\s", "ünicode", r"a\\b", "ab*c"]
    rows = spark.createDataFrame([(p,) for p in patterns], "p string")
    got = {r.p: r.n for r in rows.select("p", rule_index.needle(F.col("p")).alias("n")).collect()}
    for p in patterns:
        want = match.plain_text(p)
        want = match.required_text(p) if want is None else want
        assert got[p] == want or len(got[p]) == len(want), p


def test_a_hundred_thousand_rules(spark):
    r = random.Random(4)

    def name(n):
        return "".join(r.choices("abcdefghij-", k=n))

    hosts = [(f"h{i}", f"{name(r.randint(2, 20))}.{name(3)}", True) for i in range(50_000)]
    plain = [(f"p{i}", re.escape(name(r.randint(4, 24))), False) for i in range(49_800)]
    real = [(f"r{i}", rf"{name(6)}\d+{name(2)}", False) for i in range(150)]
    few = [("e1", r"\d{9}", False), ("e2", "é", True), ("e3", "x|y", False), ("e4", "Zq", True), (None, None, True)]
    rules = [*hosts, *plain, *real, *few]
    r.shuffle(rules)
    texts = []
    for i in range(40):
        parts = [name(r.randint(5, 60)) for _ in range(6)]
        for _, pattern, is_host in r.sample(hosts, 3) + r.sample(plain, 3):
            parts.append(pattern if is_host else re.sub(r"\\(.)", r"\1", pattern).upper())
        parts.append(re.sub(r"\\d\+", "42", r.choice(real)[1]))
        texts.append((f"t{i}", (" ", "😀", "é", "\n")[i % 4].join(parts)))
    edge = hosts[0][1]  # across the border of two blocks, and at the very end
    texts += [("long", "😀" * (rule_index.BLOCK - 3) + edge + " 123456789 " + "a" * 70_000 + edge), ("none", None), ("empty", "")]
    texts.append(("case", hosts[1][1].upper() + " ZQ zQ"))
    frame = spark.createDataFrame(texts, "text_key string, text string").repartition(4)
    table = spark.createDataFrame(rules, "rule string, pattern string, is_host boolean")
    got = {(x.text_key, x.rule) for x in rule_index.matches(frame, table).collect()}
    want = set()
    for key, text in texts:
        low = (text or "").lower()
        for rule, pattern, is_host in rules:
            if text is None or pattern is None:
                continue
            if is_host or rule[0] == "p":
                hit = pattern in text if is_host else re.sub(r"\\(.)", r"\1", pattern) in low
            else:
                hit = re.search(pattern, text, re.I)
            if hit:
                want.add((key, rule))
    assert len(want) > 250 and got == want
    assert {("long", hosts[0][0]), ("long", "e1")} <= got


def test_too_many_rules_without_text(spark, monkeypatch):
    monkeypatch.setattr(rule_index, "MOST_EVERYWHERE", 2)
    frame = spark.createDataFrame([("a", "abc")], "text_key string, text string")
    table = spark.createDataFrame([(str(i), f"[a-{i}]", False) for i in range(3)], "rule string, pattern string, is_host boolean")
    with pytest.raises(ValueError):
        rule_index.matches(frame, table)
    assert rule_index.matches(frame, table.limit(0)).count() == 0


def test_a_text_is_cut_up_once_for_both_lengths_of_pieces(spark):
    needles = {"long": "google-analytics", "short": "fbq(", "eight": "abcdefgh", "seven": "qrstuvw"}
    rules = spark.createDataFrame([(k, v, True) for k, v in needles.items()], "rule string, needle string, folded boolean")
    body = "x" * (rule_index.BLOCK - 3)
    texts = ["", "FBQ(", "...fbq(", "abcdefg", "xABCDEFGH", "qrstuvw", body + "google-analytics", body + "qrstuvw", None, "éfbq(é"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "text_key string, text string")
    found = rule_index.found(df, rules)
    got = {(r.text_key, r.rule) for r in found.collect()}
    assert got == {(str(i), k) for i, t in enumerate(texts) for k, v in needles.items() if t and v in t.lower()}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode(regexp_extract_all") == 2  # blocks, and pieces of them
