"""Categorisation: rules by priority, history, people; first match by trust."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import digits, normalize
from .grams import beside, containing, folded, rarest, required_literal
from .intervals import in_interval

#: How far each route is trusted.
CONFIDENCE = {"rule_tax_id": 1.0, "rule_text": 0.95, "history_tax_id": 0.9, "history_description": 0.85, "person": 0.7}


#: Rules, or people, up to which each subject is compared with all of them.
BESIDE = 1_000


def valid_rules(rules: DataFrame) -> DataFrame:
    """Active rules; those whose pattern is no regular expression of the machine that runs it match nothing. Each is compiled where it is read."""
    compiles = F.call_function("try_reflect", F.lit("java.util.regex.Pattern"), F.lit("matches"), F.coalesce("pattern", F.lit("")), F.lit(""))
    return rules.where(F.col("active") & ((F.col("match_type") != "regex") | compiles.isNotNull()))


def _holds() -> Column:
    """Conditions of every rule that states them: account and amount bounds."""
    return ((F.col("account_id").isNull() | (F.col("account_id") == F.col("s_account")))
            & (F.col("amount_min").isNull() | (F.col("amount") >= F.col("amount_min"))) & (F.col("amount_max").isNull() | (F.col("amount") <= F.col("amount_max"))))


def _fits() -> Column:
    """Whether a regular rule's pattern is found in the description, whatever the case of its letters."""
    return F.expr("regexp_like(description, concat('(?iu)', if(match_type = 'regex', pattern, '')))")


def matches(subjects: DataFrame, rules: DataFrame) -> DataFrame:
    """(subject_id, rule_id, category_id, by_tax_id, priority): every rule that applies to every subject.

    Account, amount bounds and counterparty are conditions of every rule that states them; a
    counterparty without digits is nobody. A counterparty rule whose pattern is empty or * needs no
    text; a rule of amount_range needs a bound.

    Up to BESIDE rules are broadcast and compared with each subject. More of them meet
    subjects by equality: of the counterparty; of the text; of the rarest gram
    of a text that must be contained (of a regular expression: the letters that it
    requires); of the block of an amount range. Only regular expressions that require no
    letters are tried on every different description. So rules may be as many as subjects.
    """
    s = subjects.select(F.col("id").alias("subject_id"), "description", normalize(F.col("description")).alias("text"), F.abs("cents").alias("amount"),
                        F.col("account_id").alias("s_account"), digits(F.coalesce("counterparty_tax_id", F.lit(""))).alias("tax"))
    r = valid_rules(rules).select(F.col("id").alias("rule_id"), "priority", "match_type", "pattern", "amount_min", "amount_max", "account_id", "category_id",
                                  F.col("counterparty_tax_id").isNotNull().alias("bound"), digits(F.coalesce("counterparty_tax_id", F.lit(""))).alias("r_tax"), normalize(F.coalesce("pattern", F.lit(""))).alias("r_text"))
    identity = F.col("bound") & F.trim(F.coalesce("pattern", F.lit(""))).isin("", "*")
    ranged = F.col("amount_min").isNotNull() | F.col("amount_max").isNotNull()
    literal = F.when(F.col("match_type") == "regex", required_literal(F.col("pattern")))
    way = (F.when(F.col("bound"), F.when(F.col("r_tax") != "", "tax")).when(F.col("match_type") == "exact", "exact").when((F.col("match_type") == "contains") & (F.col("r_text") != ""), "contains")
           .when((F.col("match_type") == "amount_range") & ranged, "range").when(F.col("match_type") == "regex", F.when(literal.isNotNull(), "letters").when(F.col("pattern").isNotNull(), "any")))
    r = r.withColumns({"identity": identity, "letters": literal, "way": way}).where("way is not null")
    text = (F.when(F.col("identity"), True).when(F.col("match_type") == "contains", (F.col("r_text") != "") & F.col("text").contains(F.col("r_text"))).when(F.col("match_type") == "exact", F.col("text") == F.col("r_text"))
            .when(F.col("match_type") == "amount_range", ranged).when(F.col("match_type") == "regex", _fits()))
    shown = ["subject_id", "rule_id", "category_id", F.col("bound").alias("by_tax_id"), "priority"]
    if r.limit(BESIDE + 1).count() <= BESIDE:
        return s.join(F.broadcast(r), _holds() & (~F.col("bound") | (F.col("r_tax") == F.col("tax"))) & text).select(*shown)
    ways = {row[0] for row in r.select("way").distinct().collect()}  # six at most
    of = lambda name: r.where(F.col("way") == name)
    found = []
    if "tax" in ways:
        found.append(s.join(of("tax"), F.col("tax") == F.col("r_tax")).where(text))
    if "exact" in ways:
        found.append(s.join(of("exact"), F.col("text") == F.col("r_text")))
    if "contains" in ways:
        pairs = containing(s.select("text").where("text is not null").distinct(), "text", of("contains"), "r_text")
        found.append(s.join(pairs, "text").join(of("contains"), "r_text"))
    if "letters" in ways:
        said = s.withColumn("_said", folded(F.col("description")))
        pairs = containing(said.select("_said").where("_said is not null").distinct(), "_said", of("letters"), "letters")
        found.append(said.join(pairs, "_said").join(of("letters"), "letters").where(_fits()))
    if "any" in ways:
        pairs = beside(s.select("description").where("description is not null").distinct(), of("any")).where(_fits())
        found.append(s.join(pairs, "description"))
    if "range" in ways:
        low, high = F.coalesce("amount_min", F.lit(0)), F.coalesce("amount_max", F.lit(1 << 62))
        spans = of("range").withColumns({"_low": low.cast("long"), "_high": high.cast("long")})
        for keys, own in ((["s_account"], spans.where("account_id is not null").withColumn("s_account", F.col("account_id"))), ([], spans.where("account_id is null"))):
            found.append(in_interval(s, own, keys, "amount", "_low", "_high"))
    return reduce(DataFrame.unionByName, [f.where(_holds()).select(*shown) for f in found])


def first_rule(subjects: DataFrame, rules: DataFrame) -> DataFrame:
    """The rule that decides: those bound to the counterparty first, then by priority and id."""
    order = Window.partitionBy("subject_id").orderBy(F.desc("by_tax_id"), "priority", "rule_id")
    return matches(subjects, rules).withColumn("k", F.row_number().over(order)).where("k = 1").drop("k", "priority")


def latest(history: DataFrame, key: str) -> DataFrame:
    """(key, category_id) of the last entry of each key, the greatest category of a tie."""
    return history.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.max_by("category_id", F.struct("occurred_on", "category_id")).alias("category_id"))


def by_person(subjects: DataFrame, people: DataFrame) -> DataFrame:
    """(subject_id, person_id): people of whose name two parts of three letters or more stand in the description; most parts first, then the larger share of the name, then by id.

    Up to BESIDE people are broadcast. Of n parts, two can't stand in a text without one of
    any n - 1: so of more people, each is looked up by all parts but the commonest, and the
    whole test is made on those who are met.
    """
    parts = people.select(F.col("id").alias("person_id"), F.filter(F.split(normalize(F.col("name")), " "), lambda w: F.length(w) >= 3).alias("parts")).where(F.size("parts") >= 2)
    s = subjects.select(F.col("id").alias("subject_id"), normalize(F.col("description")).alias("text")).where("text is not null")
    found = F.size(F.filter("parts", lambda w: F.col("text").contains(w)))
    if parts.limit(BESIDE + 1).count() <= BESIDE:
        score = s.join(F.broadcast(parts), found >= 2).select("subject_id", "person_id", (found + found / F.size("parts")).alias("score"))
        return score.groupBy("subject_id").agg(F.min_by("person_id", F.struct(-F.col("score"), "person_id")).alias("person_id"))
    texts, each = s.select("text").distinct(), parts.select("person_id", "parts", F.posexplode("parts").alias("_at", "part"))
    index = rarest(texts, "text", each, "part")
    common = Window.partitionBy("person_id").orderBy(F.desc("_texts"), "_at")
    sought = each.join(index, "part", "left").na.fill(0, ["_texts"]).withColumn("_k", F.row_number().over(common)).where("_k > 1").select("person_id", "parts", "part")
    met = containing(texts, "text", sought, "part", index).join(sought, "part").select("text", "person_id", "parts").distinct()
    score = met.where(found >= 2).select("text", "person_id", (found + found / F.size("parts")).alias("score"))
    best = score.groupBy("text").agg(F.min_by("person_id", F.struct(-F.col("score"), "person_id")).alias("person_id"))
    return s.join(best, "text").select("subject_id", "person_id")


def suggest(subjects: DataFrame, rules: DataFrame, history: DataFrame, people: DataFrame, payroll_category: int | None) -> DataFrame:
    """(subject_id, category_id, person_id, source, confidence, rule_id); source none where nothing is known."""
    h = history.select("category_id", "occurred_on", normalize(F.col("description")).alias("text"), digits(F.coalesce("counterparty_tax_id", F.lit(""))).alias("tax"))
    s = subjects.select(F.col("id").alias("subject_id"), normalize(F.col("description")).alias("text"), digits(F.coalesce("counterparty_tax_id", F.lit(""))).alias("tax"))
    rows = s.join(first_rule(subjects, rules).withColumnRenamed("category_id", "rule_category"), "subject_id", "left")
    rows = rows.join(latest(h, "tax").withColumnRenamed("category_id", "tax_category"), "tax", "left").join(latest(h, "text").withColumnRenamed("category_id", "text_category"), "text", "left")
    rows = rows.join(by_person(subjects, people), "subject_id", "left")
    person = F.col("person_id").isNotNull() & F.lit(payroll_category is not None)
    source = (F.when(F.col("rule_id").isNotNull(), F.when(F.col("by_tax_id"), "rule_tax_id").otherwise("rule_text")).when(F.col("tax_category").isNotNull(), "history_tax_id")
              .when(F.col("text_category").isNotNull(), "history_description").when(person, "person").otherwise("none"))
    rows = rows.withColumn("source", source)
    category = (F.when(F.col("source").startswith("rule"), F.col("rule_category")).when(F.col("source") == "history_tax_id", F.col("tax_category"))
                .when(F.col("source") == "history_description", F.col("text_category")).when(F.col("source") == "person", F.lit(payroll_category)))
    trust = F.lit(0.0)
    for name, value in CONFIDENCE.items():
        trust = F.when(F.col("source") == name, value).otherwise(trust)
    return rows.select("subject_id", category.cast("long").alias("category_id"), F.when(F.col("source") == "person", F.col("person_id")).alias("person_id"), "source", trust.alias("confidence"), "rule_id")


#: Fixed value: from this confidence on a suggestion is taken without being asked for.
SURE = 0.8


def sure(entries: DataFrame, suggestions: DataFrame) -> DataFrame:
    """(id, category_id, source, confidence): what entries (id, category_id) without a category take from suggestions; those that have one stay as they are."""
    s = suggestions.where(F.col("category_id").isNotNull() & (F.col("confidence") >= SURE)).select(F.col("subject_id").alias("id"), "category_id", "source", "confidence")
    return entries.where("category_id is null").select("id").join(s, "id")


def starts_chosen(category: Column, source: Column, confidence: Column) -> Column:
    """Whether a staged row is chosen before its reader looks: its category is known, and does not come from a model, or from one that is sure."""
    return category.isNotNull() & F.coalesce((source != "ai") | (confidence >= SURE), F.lit(False))


def import_decisions(staged: DataFrame, suggestions: DataFrame) -> DataFrame:
    """(import_id, pending, undecided, chosen) from staged rows (id, import_id, status): pending rows, those without a suggested category, and those that start out chosen.

    A row starts out chosen as starts_chosen says.
    """
    rows = staged.where("status = 'pending'").join(suggestions.select(F.col("subject_id").alias("id"), "category_id", "source", "confidence"), "id", "left")
    known = F.col("category_id").isNotNull()
    return rows.groupBy("import_id").agg(F.count("*").alias("pending"), F.count(F.when(~known, 1)).alias("undecided"), F.count(F.when(starts_chosen(F.col("category_id"), F.col("source"), F.col("confidence")), 1)).alias("chosen"))
