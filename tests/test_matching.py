"""Rules and people found through an index, against comparing all with all in plain Python; no cap and no nested loop."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from duoledger.operators import categorize, grams

RULE = "id string, priority int, match_type string, pattern string, counterparty_tax_id string, amount_min long, amount_max long, account_id long, category_id long, active boolean"
SUBJECT = "id long, description string, cents long, account_id long, counterparty_tax_id string"


def norm(t):
    return " ".join("".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)).upper().split())


@pytest.mark.parametrize(("pattern", "letters"), [
    (r"view\s+1\d$", "VIEW"), (r"^ab", None), (r"abc?", None), (r"abcd?", "ABC"), (r"abc+d", "ABC"), (r"ab|cde", None), (r"(abc)?defg", "DEFG"), (r"(a(b)c)*", None), (r"[abc]def", "DEF"), (r"x{2}yzz", "YZZ"),
    (r"(?i)abc", None), (r"\x41bcd", None), (r"\Qabc\E", None), (r"pix  de", "PIX  DE"), (r"é abc", " ABC"), (r"abc\.def1", "DEF1"), (r"a.bcd.*ef", "BCD"), (r"[]a]bcd", None), ("", None), (None, None)])
def test_required_letters(spark, pattern, letters):
    got = spark.createDataFrame([(pattern,)], "p string").select(grams.required_literal(F.col("p"))).first()[0]
    assert got == letters


def test_containing(spark):
    rng = random.Random(2)
    texts = sorted({"".join(rng.choice("abc ") for _ in range(rng.randrange(12))) for _ in range(300)} | {"", "ab", "😀abc"})
    patterns = sorted({"".join(rng.choice("abc ") for _ in range(rng.randrange(1, 6))) for _ in range(80)} | {"", "zzz", "abz", "😀a", "b"})
    t, p = spark.createDataFrame([(x,) for x in texts], "t string"), spark.createDataFrame([(x,) for x in patterns] * 2, "p string")
    got = sorted((r.t, r.p) for r in grams.containing(t, "t", p, "p").collect())
    assert got == sorted((x, y) for x in texts for y in patterns if y and y in x)
    assert grams.containing(t, "t", p.where("p = ''"), "p").count() == 0 and grams.containing(t.where("false"), "t", p, "p").count() == 0


def plain(subjects, rules):
    """All rules of all subjects, one by one."""
    out = set()
    for sid, text, cents, account, tax in subjects:
        for rid, _, kind, pattern, rule_tax, low, high, own, _, active in rules:
            d, t = (re.sub(r"\D", "", x or "") for x in (rule_tax, tax))
            if not active or (own is not None and own != account) or (low is not None and abs(cents) < low) or (high is not None and abs(cents) > high) or (rule_tax is not None and (not d or d != t)):
                continue
            if rule_tax is not None and (pattern or "").strip() in ("", "*"):
                out.add((sid, rid))
            elif kind == "amount_range":
                out |= {(sid, rid)} if low is not None or high is not None else set()
            elif text is None or pattern is None:
                continue
            elif kind == "regex":
                try:
                    out |= {(sid, rid)} if re.search(pattern, text, re.IGNORECASE) else set()
                except re.error:
                    pass
            elif kind == "exact":
                out |= {(sid, rid)} if norm(text) == norm(pattern) else set()
            elif norm(pattern) and norm(pattern) in norm(text):
                out.add((sid, rid))
    return out


def test_rules_of_every_kind(spark, monkeypatch):
    rng = random.Random(4)
    words = ["pix", "Transferência", "TRANSAÇÃO", "cartão", "padaria", "Uber", "a", "12"]
    subjects = [(i, rng.choice([None, "", " ".join(rng.choices(words, k=rng.randrange(1, 5)))]) if i % 5 == 0 else " ".join(rng.choices(words, k=3)), rng.randrange(-900, 900), rng.randrange(4), rng.choice([None, "1", "2.2"])) for i in range(250)]
    patterns = {"contains": [*words, "pix cart", "ao", "r", "", None, "*"], "exact": ["pix pix pix", "UBER uber uber", "nada"], "regex": [r"transação", r"pix\s+u", r".*", r"^a", "([", r"uber|pix", r"pad(aria)?", "CARTÃO"], "amount_range": ["", None]}
    rules = []
    for i in range(160):
        kind = rng.choice(list(patterns))
        rules.append((f"r{i}", i, kind, rng.choice(patterns[kind]), rng.choice([None] * 4 + ["1", "22", "--"]), rng.choice([None, 100]), rng.choice([None, 500]), rng.choice([None, None, 2]), i % 9, i % 11 > 0))
    s, r = spark.createDataFrame(subjects, SUBJECT), spark.createDataFrame(rules, RULE)
    assert {(x.subject_id, x.rule_id) for x in categorize.matches(s, r).collect()} == plain(subjects, rules)  # few rules: each with each
    monkeypatch.setattr(categorize, "BESIDE", 1)
    found = categorize.matches(s, r)
    assert {(x.subject_id, x.rule_id) for x in found.collect()} == plain(subjects, rules) and found.count() == len(plain(subjects, rules))
    shown = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in shown and "Cartesian" not in shown
    assert categorize.matches(s, r.where("false")).count() == 0 and categorize.matches(s.where("false"), r).count() == 0


def test_a_hundred_thousand_rules(spark):
    rules = spark.range(100_000).select(
        F.concat(F.lit("r"), "id").alias("id"), F.col("id").cast("int").alias("priority"), F.when(F.col("id") % 2 == 0, "contains").otherwise("regex").alias("match_type"), F.concat(F.lit("shop number "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("pattern"),
        F.lit(None).cast("string").alias("counterparty_tax_id"), F.lit(None).cast("long").alias("amount_min"), F.lit(None).cast("long").alias("amount_max"), F.lit(None).cast("long").alias("account_id"), (F.col("id") % 7).alias("category_id"), F.lit(True).alias("active"))
    subjects = spark.range(2000).select("id", F.concat(F.lit("Paid at SHOP number "), F.lpad((F.col("id") * 37).cast("string"), 6, "0"), F.lit(" today")).alias("description"), F.lit(5).cast("long").alias("cents"), F.lit(1).cast("long").alias("account_id"), F.lit(None).cast("string").alias("counterparty_tax_id"))
    got = {r.subject_id: r.rule_id for r in categorize.first_rule(subjects, rules).collect()}
    assert got == {i: f"r{37 * i}" for i in range(2000)}


@pytest.mark.parametrize("few", [1, 1000])
def test_people_by_two_parts_of_their_name(spark, monkeypatch, few):
    monkeypatch.setattr(categorize, "BESIDE", few)
    rng = random.Random(6)
    first, last = ["Ana", "João", "Maria", "Li", "Bo"], ["Silva", "Souza", "Silva", "Lima", "de", "Sá"]
    people = [(f"p{i:03}", " ".join([rng.choice(first), *rng.choices(last, k=rng.randrange(0, 3))])) for i in range(120)] + [("none", None), ("twice", "Ana Ana")]
    subjects = [(i, None if i == 3 else " ".join(["PIX", rng.choice(first), *rng.choices(last, k=2)])) for i in range(80)]
    got = {r.subject_id: r.person_id for r in categorize.by_person(spark.createDataFrame(subjects, "id long, description string"), spark.createDataFrame(people, "id string, name string")).collect()}
    want = {}
    for sid, text in subjects:
        scores = []
        for pid, name in people:
            parts = [p for p in norm(name or "").split() if len(p) >= 3]
            n = sum(p in norm(text or "") for p in parts)
            if len(parts) >= 2 and n >= 2:
                scores.append((-(n + n / len(parts)), pid))
        if scores:
            want[sid] = min(scores)[1]
    assert got == want
