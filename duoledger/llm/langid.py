"""Language ID by Bayesian fusion: text likelihoods, declared language, address suffix and smoothed host priors."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, release, small, stored

#: Buckets of hashed letter trigrams; rows of each declared language that teach, at most about.
BUCKETS = 1 << 14
TRAIN_ROWS = 3_000
#: A declared code is a language if so many rows declare it, and if of texts that didn't teach this share is taken for it.
LEAST_ROWS, CONFIRMED = 6, 0.5
#: Characters handled at once.
CHUNK = 1 << 20
#: A text is undecided below these counts and shares.
LEAST_TRIGRAMS, LEAST_LETTERS, LEAST_POSTERIOR = 3, 0.25, 0.5
#: Trigrams of a text are not independent: their log-likelihood counts by this factor, and no text's by more than the limit.
TEMPER, MOST_EVIDENCE = 0.25, 60.0


@dataclass
class TextModel:
    """languages in code-point order; logp: BUCKETS x languages, log-probability of each trigram less the mean of the languages."""

    languages: list[str]
    logp: np.ndarray


def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(1 << 16)), dtype=bool, count=1 << 16)


def trigrams(text: str, letters: np.ndarray) -> tuple[np.ndarray, int]:
    """Hashes of the trigrams whose middle is a letter, other characters standing as spaces; and the number of letters."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = letters[np.minimum(code, 0xFFFF)] | (code > 0xFFFF)
    code = np.where(letter, code, 32).astype(np.uint32)
    grams = code[:-2] * np.uint32(0x9E3779B1) + code[1:-1] * np.uint32(0x85EBCA77) + code[2:] * np.uint32(0xC2B2AE3D)
    grams ^= grams >> np.uint32(15)
    return (grams % np.uint32(BUCKETS))[letter[1:-1]].astype(np.int32), int(letter.sum())


def constant(values: list, kind: str) -> Column:
    """An array of any length as one expression."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def chunks(text: str) -> Iterator[str]:
    for i in range(0, len(text), CHUNK):
        yield text[i : i + CHUNK]


def learn(rows: DataFrame, languages: list[str], beta: float = 0.5) -> TextModel:
    """From (text, declared); counts come back as one number for each language and bucket."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, sums = _letters(), {}
        for part in parts:
            for text, language in zip(part["text"], part["declared"], strict=True):
                for chunk in chunks(text or ""):
                    sums[language] = sums.get(language, 0) + np.bincount(trigrams(chunk, letters)[0], minlength=BUCKETS)
        for language, n in sums.items():
            hit = np.flatnonzero(n)
            yield pd.DataFrame({"declared": language, "bucket": hit.astype("int32"), "n": n[hit].astype("int64")})

    found = rows.mapInPandas(run, "declared string, bucket int, n long").groupBy("declared", "bucket").agg(F.sum("n").alias("n"))
    found = found.select(F.array_position(constant(languages, "string"), F.col("declared")).cast("int").alias("at"), "bucket", "n").toArrow()
    counts = np.zeros((BUCKETS, len(languages)))
    counts[found["bucket"].to_numpy(), found["at"].to_numpy() - 1] = found["n"].to_numpy()
    logp = np.log((counts + beta) / (counts.sum(0) + beta * BUCKETS))
    return TextModel(languages, (logp - logp.mean(1, keepdims=True)).astype(np.float32))


def text_scores(rows: DataFrame, model: TextModel) -> DataFrame:
    """rows with text replaced by n (trigrams), letters, chars and ll (log-likelihood of each language)."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        letters = _letters()
        for part in parts:
            n, found, chars, ll = [], [], [], []
            for text in part["text"]:
                total, k, m = np.zeros(len(model.languages)), 0, 0
                for chunk in chunks(text or ""):
                    grams, own = trigrams(chunk, letters)
                    times = np.bincount(grams, minlength=BUCKETS) if len(grams) > BUCKETS else None
                    total += times @ model.logp if times is not None else model.logp[grams].sum(0, dtype=np.float64)
                    k, m = k + len(grams), m + own
                n.append(k)
                found.append(m)
                chars.append(sum(map(len, (text or "").split())))
                ll.append(total)
            yield part.drop(columns="text").assign(n=np.array(n, "int64"), letters=np.array(found, "int64"), chars=np.array(chars, "int64"), ll=ll)

    kept = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "text")
    return rows.mapInPandas(run, f"{kept}, n long, letters long, chars long, ll array<double>")


def confirmed(teach: DataFrame) -> list[str]:
    """Codes of (text, declared, fold) whose texts of fold 1 are told as theirs by what fold 0 teaches; all codes, where none is."""
    codes = sorted(r["declared"] for r in teach.select("declared").distinct().collect())
    if len(codes) < 2:
        return codes
    told = text_scores(teach.where("fold = 1").select("text", "declared"), learn(teach.where("fold = 0").select("text", "declared"), codes))
    told = told.where("n > 0").withColumn("told", F.element_at(constant(codes, "string"), F.array_position("ll", F.array_max("ll")).cast("int")))
    share = told.groupBy("declared").agg(F.avg((F.col("told") == F.col("declared")).cast("double")).alias("share")).collect()
    return sorted(r["declared"] for r in share if r["share"] >= CONFIRMED) or codes


def identify(rows: DataFrame) -> DataFrame:
    """rows (key columns, text, declared, host, suffix) with text replaced by: language, posterior, text_language, accepted.

    The languages are the declared codes (two or three letters) of at least LEAST_ROWS rows that
    their own texts confirm: of a half that taught, texts of the other half must be told as that
    language. How many rows declare others doesn't matter, and there may be any number. At most
    about TRAIN_ROWS rows of each teach, chosen by a hash of the row. Text likelihoods come from hashed letter trigrams. What texts alone say is counted by host,
    by address suffix and in all, each level smoothed by the one above: that is the prior.
    How often a declared language goes with each text language gives its likelihood.
    accepted: the text has trigrams, a quarter of it are letters, and the posterior is 0.5 or more.

    Null and empty texts, and texts without letters, rest on the other evidence and are not
    accepted. Null or unknown declared values, hosts and suffixes are values of their own.
    Ties go to the first language by code point. Repeated rows get equal results. Where no
    language is declared anywhere, language is null. Very long texts are counted in pieces of a
    megabyte; how much one text may say is limited (MOST_EVIDENCE). Key columns pass through.
    """
    own = [c for c in rows.columns if c not in ("text", "declared", "host", "suffix")]
    rows = rows.withColumn("declared", F.lower(F.regexp_extract(F.coalesce("declared", F.lit("")), r"^\s*([A-Za-z]+)", 1)))
    codes = rows.where(F.col("declared").rlike("^[a-z]{2,3}$")).groupBy("declared").count().where(F.col("count") >= LEAST_ROWS)
    codes = codes.select("declared", F.least(F.lit(1.0), TRAIN_ROWS / F.col("count")).alias("share"))
    by_row = F.xxhash64(F.lit("teach"), *rows.columns)
    teach = rows.withColumn("chance", by_row).join(F.broadcast(codes), "declared").where(F.pmod("chance", F.lit(1 << 20)) < F.col("share") * (1 << 20))
    teach = stored(teach.select("text", "declared", F.expr("pmod(shiftright(chance, 32), 2)").alias("fold")), "teach")
    languages = confirmed(teach)
    if not languages:
        empty = {"language": F.lit(None).cast("string"), "posterior": F.lit(0.0), "text_language": F.lit(None).cast("string"), "accepted": F.lit(False)}
        return rows.select(*own, *[v.alias(k) for k, v in empty.items()])
    model = learn(teach.where(F.col("declared").isin(languages)).select("text", "declared"), languages)
    scored = stored(text_scores(rows, model), "language")
    scored = scored.withColumn("declared", F.when(F.col("declared").isin(languages), F.col("declared")).otherwise(""))
    scored = scored.withColumn("host", F.coalesce("host", F.lit(""))).withColumn("suffix", F.coalesce("suffix", F.lit("")))
    names, many = constant(languages, "string"), len(languages)
    decided = (F.col("n") >= LEAST_TRIGRAMS) & (F.col("letters") >= LEAST_LETTERS * F.col("chars"))
    scored = scored.withColumn("text_at", F.when(decided, (F.array_position("ll", F.array_max("ll")) - 1).cast("int")))

    # counts stand as maps from languages to numbers, so plans and tables don't grow with the square of the languages
    of = lambda found, *key: found.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.when(F.col("text_at").isNotNull(), F.struct("text_at", "n")))).alias("found"), F.coalesce(F.sum(F.when(F.col("text_at").isNotNull(), F.col("n"))), F.lit(0.0)).alias("total"))
    n = F.expr(f"transform(sequence(0, {many - 1}), i -> coalesce(found[i], 0D))")
    each = stored(scored.groupBy("suffix", "host", "declared", "text_at").agg(F.count("*").cast("double").alias("n")), "evidence")
    summed = lambda *key: each.groupBy(*key, "text_at").agg(F.sum("n").alias("n"))
    everywhere = np.zeros(many)
    for r in summed().where("text_at is not null").collect():
        everywhere[r["text_at"]] = r["n"]
    root = constant(((everywhere + 1) / (everywhere + 1).sum()).tolist(), "double")
    suffixes = of(summed("suffix"), "suffix").select("suffix", _smoothed(n, root, 50.0).alias("above"))
    hosts = of(summed("suffix", "host"), "suffix", "host").join(small(suffixes, 100_000), "suffix").select("suffix", "host", _smoothed(n, F.col("above"), 10.0).alias("prior"))
    kinds = rows.sparkSession.createDataFrame([(-1, ""), *enumerate(languages)], "own int, declared string")
    likely = F.expr(f"transform(sequence(0, {many - 1}), i -> ln((coalesce(found[i], 0D) + if(i = own, 2D, 0.2D)) / (sums[i] + {2 + 0.2 * many}D)))")
    said = kinds.join(of(summed("declared"), "declared"), "declared", "left").withColumn("sums", constant(everywhere.tolist(), "double")).select("declared", likely.alias("said"))
    scored = scored.join(small(hosts, 200_000), ["suffix", "host"]).join(F.broadcast(said), "declared")  # a row for each language
    scored = scored.withColumn("most", F.array_max("ll"))
    log = F.expr(f"""transform(ll, (x, i) -> greatest((x - most) * {TEMPER}D, -{MOST_EVIDENCE}D) + ln(prior[i]) + said[i])""")
    scored = scored.withColumn("log", log).withColumn("best", F.array_max("log"))
    posterior = F.expr("1D / aggregate(log, 0D, (s, x) -> s + exp(x - best))")
    return scored.select(*own, F.element_at(names, F.array_position("log", F.col("best")).cast("int")).alias("language"), posterior.alias("posterior"),
                         F.element_at(names, F.col("text_at") + 1).alias("text_language"), (decided & (posterior >= LEAST_POSTERIOR)).alias("accepted"))


def _smoothed(n: Column, above: Column, strength: float) -> Column:
    """Shares of counts n, of sum total, pulled toward those of the level above."""
    return F.transform(F.arrays_zip(n.alias("n"), above.alias("a")), lambda x: (x["n"] + strength * x["a"]) / (F.col("total") + strength))


def pages_as_rows(pages: DataFrame) -> DataFrame:
    """(page_id, text, declared, host, suffix) of raw pages: text without scripts, styles, comments, tags and references."""
    text = F.regexp_replace("html", r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>|&#?\w+;", " ")
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    return pages.select("page_id", text.alias("text"), F.regexp_extract("html", r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([\w-]+)""", 1).alias("declared"),
                        host.alias("host"), F.regexp_extract(host, r"([^.]+)$", 1).alias("suffix"))


def documents_as_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, declared, host, suffix): the source stands as host, and there is no address."""
    return docs.select("doc_id", "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.lit(None).cast("string").alias("suffix"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and all pages, each with its language; a row has a doc_id or a page_id."""
    docs = documents_as_rows(read(spark, sf_dir, "documents")).withColumn("page_id", F.lit(None).cast("long"))
    pages = stored(pages_as_rows(read(spark, sf_dir, "pages")), "page_rows")  # cleaned once, read three times
    return identify(docs.unionByName(pages.withColumn("doc_id", F.lit(None).cast("long"))))
