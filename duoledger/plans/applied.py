"""Queries of a ledger after batches were applied to it, each of them twice."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import approval
from ..sources import proxy
from ..sources.ledger import Ledger
from ..sources.store import shared_folder, written
from .contracts import EXISTING, RECOGNISED, c11
from .flows import KNOWN, MIRRORED, STAGED, _saved, staged
from .registry import query


def _ledger(spark, schema: str, key: list[str], parts: list[str], first: DataFrame) -> Ledger:
    """A ledger of its own that holds the first rows."""
    ledger = Ledger(spark, f"{shared_folder(spark)}/duoledger/ledger-{uuid.uuid4().hex}", schema, key, parts)
    ledger.apply("first", first.withColumn("action", F.lit("insert")))
    return ledger


@query("k9_applied", RECOGNISED + EXISTING + """
SELECT coalesce(p.contract_id, e.contract_id) AS contract_id, coalesce(p.period, e.period) AS period, coalesce(CASE WHEN manually_edited THEN e.cents ELSE planned END)::BIGINT AS cents
FROM plan p FULL JOIN existing e ON p.contract_id = e.contract_id AND p.period = e.period WHERE coalesce(manually_edited, false) OR planned IS NOT NULL""")
def k9_applied(spark, sf_dir):
    """The recognition ledger after its merge plan: what stood before the merge, what it adds, changes and removes."""
    plan = written(c11(spark, sf_dir), "plan")
    first = plan.where("was is not null").select("contract_id", "period", F.col("was").alias("cents"))
    ledger = _ledger(spark, "contract_id long, period date, cents long", ["contract_id", "period"], ["period"], first)
    for _ in range(2):
        ledger.merge("merge", plan.withColumn("cents", F.col("planned")))
    return ledger.rows()


@query("k7_applied", MIRRORED + """ SELECT coalesce(a.entry_id, o.entry_id) AS entry_id, CASE WHEN action IN ('insert', 'update') THEN a.period ELSE o.period END AS period, CASE WHEN action IN ('insert', 'update') THEN a.category_id ELSE o.category_id END::BIGINT AS category_id,
  CASE WHEN action IN ('insert', 'update') THEN a.cents ELSE o.cents END::BIGINT AS cents, coalesce(edited, false) AS manually_edited FROM acts a FULL JOIN old o ON a.entry_id = o.entry_id WHERE action IS DISTINCT FROM 'delete'""")
def k7_applied(spark, sf_dir):
    """Rows of the recognition ledger after all entries were saved."""
    e, old = _saved(spark, sf_dir)
    ledger = _ledger(spark, "entry_id long, period date, category_id long, cents long, manually_edited boolean", ["entry_id"], ["period"], old)
    actions = written(approval.mirror_actions(e, proxy.chart(spark), ledger.rows()).withColumn("manually_edited", F.lit(False)), "actions")
    for _ in range(2):
        ledger.apply("saved", actions)
    return ledger.rows()


ENTERED = STAGED.replace("PARTITION BY chosen, ", "PARTITION BY ") + f" SELECT id, entity_id, hash AS dedup_hash FROM k WHERE (k = 1 AND NOT {KNOWN}) OR id IN (SELECT min(id) FROM staged WHERE id % 17 = 0 GROUP BY entity_id, hash)"


@query("k4_applied", ENTERED)
def k4_applied(spark, sf_dir):
    """A ledger of each seventeenth line after all lines came in, two times."""
    own = written(staged(spark, sf_dir).select("id", "entity_id", "dedup_hash"), "lines")
    known = own.where("id % 17 = 0").groupBy("entity_id", "dedup_hash").agg(F.min("id").alias("id"))
    ledger = _ledger(spark, "id long, entity_id int, dedup_hash string", ["entity_id", "dedup_hash"], ["entity_id"], known)
    for batch in ("all", "again"):
        ledger.admit(batch, own, ["id"])
    return ledger.rows()


@query("k13_applied", STAGED + f""", known AS (SELECT min(id) AS id, entity_id, hash FROM staged WHERE id % 17 = 0 GROUP BY ALL)
SELECT id, entity_id, hash AS dedup_hash, NULL::BIGINT AS category_id FROM known UNION ALL SELECT id, entity_id, hash, coalesce(given, suggested)::BIGINT FROM k WHERE chosen AND k = 1 AND NOT {KNOWN}""")
def k13_applied(spark, sf_dir):
    """The same ledger after the chosen lines were approved, with the categories that they took."""
    own = written(staged(spark, sf_dir), "lines")
    known = own.where("id % 17 = 0").groupBy("entity_id", "dedup_hash").agg(F.min("id").alias("id")).withColumn("category_id", F.lit(None).cast("long"))
    ledger = _ledger(spark, "id long, entity_id int, dedup_hash string, category_id long", ["entity_id", "dedup_hash"], ["entity_id"], known)
    chosen = own.where("id % 3 <> 0").select("id", F.when(F.col("id") % 2 == 0, F.col("id") % 14).alias("category_id"))
    for _ in range(2):
        done = approval.approve(own, chosen, ledger.rows(), ["id"])
        ledger.apply("approved", done.where("status = 'approved'").withColumn("action", F.lit("insert")))
    return ledger.rows()
