"""Text of statements: normal forms, tax ids, supplier keys, instalments, content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import to_numeric

#: Accented letters of the Latin-1 and Latin Extended-A sets, and their plain forms.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿĀāĂăĄąĆćČčĎďĒēĖėĘęĚěĞğĢģĪīĮįİĶķĹĺĻļĽľŃńŅņŇňŌōŐőŔŕŖŗŘřŚśŞşŠšŢţŤťŪūŮůŰűŲųŸŹźŻżŽž"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyyAaAaAaCcCcDdEeEeEeEeGgGgIiIiIKkLlLlLlNnNnNnOoOoRrRrRrSsSsSsTtTtUuUuUuUuYZzZzZz"


def normalize(text: Column) -> Column:
    """Upper case, no accents, single spaces."""
    return F.trim(F.regexp_replace(F.upper(F.translate(text, ACCENTED, PLAIN)), r"(?U)\s+", " "))


def normalize_header(text: Column) -> Column:
    """Lower case, no accents, a space for whatever is no letter or digit."""
    return F.trim(F.regexp_replace(F.lower(F.translate(text, ACCENTED, PLAIN)), "[^a-z0-9]+", " "))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def same_tax_id(a: Column, b: Column) -> Column:
    return F.coalesce((digits(a) != "") & (digits(a) == digits(b)), F.lit(False))


def _check_digit(d: Column, n: int) -> Column:
    """Modulo 11 of the first n digits, whose weights go up from the right: to 9 and again from 2, or on to 11 in the short form."""
    wrap = 8 if n >= 12 else 99
    terms = [d.substr(i + 1, 1).cast("int") * (2 + (n - 1 - i) % wrap) for i in range(n)]
    rest = sum(terms[1:], terms[0]) % 11
    return F.when(rest < 2, 0).otherwise(11 - rest)


def valid_tax_id(text: Column) -> Column:
    """Whether the two check digits of an 11- or 14-digit number fit; repeated digits never do."""
    d = digits(text)
    short = (F.length(d) == 11) & ~d.rlike(r"^(\d)\1+$")
    long = (F.length(d) == 14) & ~d.rlike(r"^(\d)\1+$")
    fits = lambda n: (d.substr(n + 1, 1).cast("int") == _check_digit(d, n)) & (d.substr(n + 2, 1).cast("int") == _check_digit(d, n + 1))
    return F.coalesce(F.when(short, fits(9)).when(long, fits(12)), F.lit(False))


def format_tax_id(text: Column) -> Column:
    d = digits(text)
    return (F.when(F.length(d) == 14, F.regexp_replace(d, r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$", "$1.$2.$3/$4-$5"))
            .when(F.length(d) == 11, F.regexp_replace(d, r"^(\d{3})(\d{3})(\d{3})(\d{2})$", "$1.$2.$3-$4")).otherwise(text))


def supplier_key(description: Column) -> Column:
    """The first two words of two signs or more, without digits, * and #."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(normalize(description), r"[0-9*#]+", " "), " +", " "))
    key = F.array_join(F.slice(F.filter(F.split(bare, " "), lambda w: F.length(w) >= 2), 1, 2), " ")
    return F.when(key != "", key).otherwise(bare)


def propose_pattern(description: Column, tax_id: Column) -> Column:
    """* for a known counterparty; else the description without dates, long numbers and trailing dashes."""
    bare = normalize(description)
    for pattern in (r"\d{1,2}/\d{1,2}(/\d{2,4})?", r"\b\d{4,}\b", r"[-*]+\s*$"):
        bare = F.regexp_replace(bare, pattern, " ")
    bare = F.trim(F.regexp_replace(bare, r"\s+", " "))
    return F.when(digits(F.coalesce(tax_id, F.lit(""))) != "", "*").when(bare != "", bare).otherwise(normalize(description))


def instalment(description: Column, at_end: bool = False) -> Column:
    """Struct of current and total of n/m (1 <= n <= m, 2 <= m <= 36), the first one or that at the end; null where there is none."""
    pattern = r"(\d{1,2})\s*/\s*(\d{1,2})\s*$" if at_end else r"\b(\d{1,2})\s*/\s*(\d{1,2})\b"
    n, m = (F.regexp_extract(description, pattern, k).try_cast("int") for k in (1, 2))
    return F.when((m >= 2) & (m <= 36) & (n >= 1) & (n <= m), F.struct(n.alias("current"), m.alias("total")))


def automatic_sweep(description: Column) -> Column:
    """Money that moves between shelves of one balance; a yield is none."""
    t = normalize_header(description)
    return ~t.contains("rend") & t.rlike(r"\b(apl|res)\b.*\baplic\b.*\baut\b")


def dedup_hash(account: Column, day: Column, cents: Column, direction: Column, description: Column, counterparty: Column, occurrence: Column) -> Column:
    """Content hash of a movement; the occurrence counts from 0 among equal ones."""
    other = F.when(F.trim(counterparty) != "", normalize(counterparty))
    return F.sha2(F.concat_ws("|", account.cast("string"), day.cast("string"), to_numeric(cents).cast("string"), direction, normalize(description), other,
                              F.when(occurrence > 0, F.concat(F.lit("#"), occurrence.cast("string")))), 256)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.translate(text, ACCENTED, PLAIN)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
