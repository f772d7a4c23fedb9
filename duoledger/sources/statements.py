"""Statements and card bills from cells and positioned text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import card_date, parse_br, parse_iso
from ..functions.money import parse_money
from ..functions.text import automatic_sweep, instalment, normalize_header

#: Headers of statement columns, by role, in order of trust.
ROLES = {
    "date": ["data", "data lancamento", "date"],
    "description": ["lancamento", "historico", "descricao", "description"],
    "counterparty": ["razao social", "nome", "favorecido"],
    "tax_id": ["cpf cnpj", "cnpj cpf", "cnpj", "cpf"],
    "amount": ["valor r", "valor", "amount"],
    "debit": ["debito r", "debito"],
    "credit": ["credito r", "credito"],
    "balance": ["saldo r", "saldo", "balance"],
}


def role_of(header: Column) -> Column:
    """Role of a header: of the name it equals, or else begins with; of several, the first."""
    h = normalize_header(header)
    heads = F.array(*[F.struct(F.lit(head).alias("head"), F.lit(name).alias("role")) for name, own in ROLES.items() for head in own])
    first = lambda fits: F.get(F.filter(heads, fits), F.lit(0))["role"]
    return F.coalesce(first(lambda x: x["head"] == h), first(lambda x: h.startswith(F.concat(x["head"], F.lit(" ")))))


def parse_statement(cells: DataFrame, file: str = "path") -> DataFrame:
    """(file, row, occurred_on, description, counterparty, tax_id, cents, direction, balance_cents, kind, reason) from (file, row, col, text).

    The header is the first row with a date and an amount (or debit, credit) column. A row
    without an amount declares a balance; rows without a date, of no amount, and sweeps of the
    same balance are discarded, each with its reason.
    """
    named = cells.withColumn("role", role_of(F.col("text")))
    has = lambda *r: F.max(F.col("role").isin(*r).cast("int")) == 1
    heads = named.groupBy(file, "row").agg(has("date").alias("d"), has("amount", "debit", "credit").alias("a")).where("d and a").groupBy(file).agg(F.min("row").alias("head"))
    first = Window.partitionBy(file, "role").orderBy("col")
    columns = named.join(heads, file).where("row = head and role is not null").withColumn("k", F.row_number().over(first)).where("k = 1").select(file, "col", F.col("role").alias("as"), "head")
    body = cells.join(columns, [file, "col"]).where("row > head").groupBy(file, "row").pivot("as", list(ROLES)).agg(F.first("text"))
    day = F.coalesce(parse_br(F.col("date")), parse_iso(F.col("date")))
    debit, credit = (F.abs(parse_money(F.col(c))) for c in ("debit", "credit"))
    rows = body.withColumns({"occurred_on": day, "signed": F.coalesce(parse_money(F.col("amount")), F.when(F.coalesce(credit, F.lit(0)) != 0, credit), -debit), "balance_cents": parse_money(F.col("balance"))})
    kind = (F.when(F.col("occurred_on").isNull(), "discarded").when(F.col("signed").isNull(), F.when(F.col("balance_cents").isNotNull(), "balance").otherwise("discarded"))
            .when((F.col("signed") == 0) | automatic_sweep(F.coalesce("description", F.lit(""))), "discarded").otherwise("movement"))
    reason = (F.when(F.col("occurred_on").isNull(), "no date").when(F.col("signed").isNull() & F.col("balance_cents").isNull(), "no amount").when(F.col("signed") == 0, "zero")
              .when(automatic_sweep(F.coalesce("description", F.lit(""))) & F.col("signed").isNotNull(), "sweep"))
    return rows.select(file, "row", "occurred_on", "description", "counterparty", "tax_id", F.abs("signed").alias("cents"), F.when(F.col("signed") >= 0, "in").when(F.col("signed") < 0, "out").alias("direction"),
                       "balance_cents", kind.alias("kind"), reason.alias("reason"))


#: Pages and bytes of a batch that a Python task holds at once.
BATCH_PAGES, BATCH_BYTES = 500, 2 << 20


def listed(items: DataFrame, file: str = "path") -> DataFrame:
    """(file, page, x, y, text) from positioned text (file, page, x, y, width, text): a page is one row that lists its items."""
    pages = items.groupBy(file, "page").agg(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "text")).alias("items"))
    return pages.select(file, "page", F.col("items.x").alias("x"), F.col("items.y").alias("y"), F.col("items.text").alias("text"))


def page_lines(pages: DataFrame, file: str = "path") -> DataFrame:
    """(file, page, line_at, line, column_at, x, y, text) from listed pages: a line is one row that lists its items from left to right.

    Columns begin at crowded places (2-point bins that hold 4 % of the page's items, three at
    least) that are 190 points apart; items within 3 points of a line's first stand on it;
    lines are read column by column. A line with an unknown text is unknown. A task reads many
    pages at once, in batches that are small whatever the table's size: from now on the session
    has no larger ones.
    """
    for what, most in (("Records", BATCH_PAGES), ("Bytes", BATCH_BYTES)):
        pages.sparkSession.conf.set(f"spark.sql.execution.arrow.max{what}PerBatch", str(most))
    return pages.mapInPandas(partial(_pages, file), f"{file} string, page int, line_at int, line string, column_at int, x array<double>, y array<double>, text array<string>")


def layout(items: DataFrame, file: str = "path") -> DataFrame:
    """(file, page, line_at, line, column_at, x, y, text) from positioned text (file, page, x, y, width, text): each item with the line that it stands on, see page_lines."""
    return page_lines(listed(items, file), file).select(file, "page", "line_at", "line", "column_at", F.inline(F.arrays_zip("x", "y", "text")))


def _starts(x: np.ndarray) -> list[float]:
    """Where the columns of a page begin."""
    bins, n = np.unique((x // 2).astype(int), return_counts=True)
    starts: list[float] = []
    for b in bins[n >= max(3, 0.04 * len(x))].tolist():
        if not starts or b * 2 - starts[-1] >= 190:
            starts.append(b * 2.0)
    return starts


def _pages(file: str, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pages in batches:
        out: list[tuple] = []
        for name, page, x, y, text in zip(pages[file], pages["page"], pages["x"], pages["y"], pages["text"], strict=True):
            column = np.maximum(np.searchsorted(_starts(x), x, side="right") - 1, 0)
            order = np.lexsort((x, -y, column))
            at, lines, top, before = -1, [], None, None
            for c, height in zip(column[order].tolist(), y[order].tolist(), strict=True):
                if c != before or top - height > 3:
                    at, top, before = at + 1, height, c
                lines.append(at)
            order = order[np.lexsort((x[order], lines))]
            ends = np.cumsum(np.bincount(lines)).tolist()
            columns, xs, ys, words = (v[order].tolist() for v in (column, x, y, text))
            for k, (i, j) in enumerate(zip([0, *ends], ends)):  # noqa: B905
                line = None if None in words[i:j] else " ".join(words[i:j])
                out.append((name, page, k, line, columns[i], xs[i:j], ys[i:j], words[i:j]))
        yield pd.DataFrame(out, columns=[file, "page", "line_at", "line", "column_at", "x", "y", "text"])


def parse_card(lines: DataFrame, reference: str, file: str = "path") -> DataFrame:
    """(file, page, line_at, card, section, occurred_on, description, cents, direction, instalment) of charges from laid-out lines (file, page, line_at, line).

    For bills of which only the text of lines is known; parse_invoice reads positioned items.
    Section and card carry down from the last line that names them; charges of instalments
    to come are left out.
    """
    order = Window.partitionBy(file).orderBy("page", "line_at")
    h = normalize_header(F.col("line"))
    section = F.when(h.contains("proximas faturas"), "future").when(h.startswith("pagamentos"), "payments").when(h.startswith("lancamentos"), "charges")
    card = F.regexp_extract("line", r"(?i)final\s+(\d{4})", 1)
    down = lambda c: F.last(c, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.withColumns({"section": down(section), "card": down(F.when(card != "", card))})
    pattern = r"^(\d{2}/\d{2})\s+(.*?)\s+(-?\s*[\d.]+,\d{2})$"
    amount = parse_money(F.regexp_extract("line", pattern, 3))
    rows = rows.where(F.col("line").rlike(pattern) & (F.coalesce("section", F.lit("")) != "future"))
    description = F.regexp_extract("line", pattern, 2)
    return rows.select(file, "page", "line_at", "card", "section", card_date(F.regexp_extract("line", pattern, 1), F.lit(reference).cast("date")).alias("occurred_on"), description.alias("description"),
                       F.abs(amount).alias("cents"), F.when(amount < 0, "in").otherwise("out").alias("direction"), instalment(description, at_end=True).alias("instalment"))


#: How far from its heading an amount may stand, and how far below a charge its further lines.
AMOUNT_REACH, FURTHER = 80.0, 24.0
#: What a line begins with (small letters, plain signs), and the section that it opens; None for lines that only end a charge.
OPENERS = {"lancamentos compras e saques": "charges", "lancamentos internacionais": "international", "lancamentos produtos e servicos": "products", "compras parceladas": "future",
           "limites de credito": "closed", "encargos cobrados": "closed", "lancamentos no cartao": None, "total transacoes inter": None, "total lancamentos inter": None, "lancamentos produtos": None}
TOTAL, TAX = "total dos lancamentos atuais", "repasse de iof"


def parse_invoice(items: DataFrame, reference: str, file: str = "path") -> DataFrame:
    """(file, page, line_at, kind, section, card, occurred_on, description, detail, cents, direction, instalment) of a card bill from laid-out items (file, page, line_at, line, column_at, x, y, text).

    kind is charge, total (the printed sum), or discarded: charges of bills to come, and
    dated lines without amount, date or description. Headings of a column say where its
    amounts stand: the amount nearest to that place within 80 points is the charge's, and
    none farther away; without a heading it is the last amount of the line. Foreign tax is a
    charge of the reference day. Lines close below a charge, in its column, are its detail.
    A bill is one group, of the size of a bill.
    """
    item = F.struct("x", F.trim("text").alias("text"))
    lines = items.groupBy(file, "page", "line_at").agg(F.max("y").alias("y"), F.max("column_at").alias("column_at"), F.max("line").alias("line"), F.array_sort(F.collect_list(item)).alias("items"))
    lines = lines.withColumn("_h", normalize_header(F.col("line")))  # once for all that it is compared with
    h = F.col("_h")
    dated = F.element_at("items", 1)["text"].rlike(r"^\d{2}/\d{2}$")
    which = lambda pattern: F.filter("items", lambda i: i["text"].rlike(pattern))
    heading = F.when(F.size(which("(?i)^data$")) > 0, F.coalesce(F.get(which(r"(?i)^valor\s+em\s+r\$$"), F.lit(0))["x"], F.try_element_at(which(r"(?i)^r\$$"), F.lit(-1))["x"]))
    opens, marker = F.lit(None).cast("string"), F.lit(False)
    for head, name in reversed(OPENERS.items()):
        opens, marker = F.when(h.startswith(head), F.lit(name)).otherwise(opens), marker | h.startswith(head)
    opens = F.when(h.contains(TOTAL), "closed").otherwise(opens)
    card = F.regexp_extract(F.trim("line"), r"\(final (\d{4})\)$", 1)
    names = (card != "") & ~h.startswith("lancamentos")
    what = (F.when(heading.isNotNull(), "heading").when(h.contains(TOTAL), "total").when(h.startswith(TAX), "tax").when(marker | names, "marker").when(dated, "dated").otherwise("plain"))
    rows = lines.withColumns({"heading": heading, "opens": F.when(heading.isNull(), opens), "names": F.when(names & heading.isNull(), card), "what": what})
    order = Window.partitionBy(file).orderBy("page", "line_at")
    down = lambda c, w: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"section": down(F.col("opens"), order), "card": down(F.col("names"), order), "at": down(F.col("heading"), Window.partitionBy(file, "column_at").orderBy("page", "line_at"))})
    amounts = F.filter(F.transform("items", lambda i, k: F.struct(F.abs(i["x"] - F.col("at")).alias("off"), k.alias("k"), F.regexp_replace(i["text"], r"\s", "").alias("bare"), i["text"].alias("text"))),
                       lambda m: m["bare"].rlike(r"^-?(R\$)?[\d.]*\d,\d{2}$"))
    rows = rows.withColumn("_amounts", F.when(F.col("what").isin("total", "tax", "dated"), amounts))  # no other line's amount counts
    near = F.array_min(F.filter("_amounts", lambda m: m["off"] <= AMOUNT_REACH))
    rows = rows.withColumn("amount", F.when(F.col("at").isNull(), F.try_element_at("_amounts", F.lit(-1))).otherwise(near)).withColumn("_cents", parse_money(F.col("amount.bare"), ","))
    day = F.lit(reference).cast("date")
    text = F.trim(F.array_join(F.transform(F.slice("items", 2, F.greatest(F.col("amount.k") - 1, F.lit(0))), lambda i: i["text"]), " "))
    tax, live = F.col("what") == "tax", F.coalesce(F.col("section").isin("charges", "international", "products"), F.lit(False))
    rows = rows.withColumns({"description": F.when(tax, "Repasse de IOF").when(F.col("what") == "dated", text), "occurred_on": F.when(tax, day).when(F.col("what") == "dated", card_date(F.element_at("items", 1)["text"], day)), "cents": F.col("_cents")})
    whole = F.coalesce((F.col("description") != "") & F.col("occurred_on").isNotNull() & F.col("cents").isNotNull(), F.lit(False))
    dated = F.col("what") == "dated"
    kind = (F.when(F.col("what") == "total", "total").when(tax & whole & (F.col("cents") != 0), "charge").when(dated & live & whole, "charge").when(dated & (live | (F.col("section") == "future")), "discarded"))
    rows = rows.withColumn("kind", kind)
    apart = (F.col("what") != "plain") | F.lag("column_at").over(order).isNull() | (F.lag("column_at").over(order) != F.col("column_at")) | (F.lag("y").over(order) - F.col("y") > FURTHER) | (F.lag("page").over(order) != F.col("page"))
    rows = rows.withColumn("run", F.sum(apart.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    below = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("what") == "plain", F.struct("page", "line_at", "line"))).over(Window.partitionBy(file, "run"))), lambda x: x["line"]), " · ")
    rows = rows.withColumn("detail", F.when((F.col("kind") == "charge") & ~tax & (below != ""), below)).where("kind is not null")
    return rows.select(file, "page", "line_at", "kind", "section", "card", "occurred_on", F.coalesce("description", F.col("line")).alias("description"), "detail", F.abs("cents").alias("cents"),
                       F.when(F.col("cents") < 0, "in").when(F.col("cents") >= 0, "out").alias("direction"), instalment(F.col("description"), at_end=True).alias("instalment"))


def reconcile_card(charges: DataFrame, printed: DataFrame, file: str = "path") -> DataFrame:
    """(file, total, printed, exact): a bill whose charges do not sum to its printed total is refused whole."""
    total = charges.where("section <> 'payments' or section is null").groupBy(file).agg(F.sum(F.when(F.col("direction") == "out", F.col("cents")).otherwise(-F.col("cents"))).alias("total"))
    return printed.join(total, file, "left").select(file, F.coalesce("total", F.lit(0)).alias("total"), "printed", (F.coalesce("total", F.lit(0)) == F.col("printed")).alias("exact"))
