"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op5
from .codes import op12
from .counts import op13
from .hmm import op8
from .infill import op11
from .jaccard import op6
from .langid import op7
from .mixing import op2
from .neighbours import op9
from .sharding import op10
from .toxicity import op1
from .webp import op4
from .wrappers import op3


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1,
        "op2_mixing": op2,
        "op3_html": op3,
        "op4_webp": op4,
        "op5_bpe": op5,
        "op6_jaccard": op6,
        "op7_language_id": op7,
        "op8_hmm": op8,
        "op9_neighbours": op9,
        "op10_sharding": op10,
        "op11_infill": op11,
        "op12_codes": op12,
        "op13_counts": op13,
    }


OP6 = r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT DISTINCT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
g AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id)::BIGINT AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN g ON g.a = d.doc_id"""
OP9 = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.93),
r AS (SELECT DISTINCT a, a AS b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
g AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1), k AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, vec_id)::BIGINT AS component_id, coalesce(component_id, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN g ON g.a = vec_id LEFT JOIN k ON k.a = vec_id"""


OP11 = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS h FROM d),
c AS (SELECT *, len(l)::BIGINT AS n, least(h[1] % (len(l) + 1), h[2] % (len(l) + 1)) AS a, greatest(h[1] % (len(l) + 1), h[2] % (len(l) + 1)) AS b FROM u),
p AS (SELECT doc_id, t, n, array_to_string(l[1:a], '') AS p, array_to_string(l[a + 1:b], '') AS m, array_to_string(l[b + 1:], '') AS s,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


def _op12(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Rounds are one named query after the other."""
    near = """SELECT vec_id, part, x, min(struct_pack(d := d, e := e)) AS best FROM (SELECT v.vec_id, v.part, v.x, b.e, list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM part_of v JOIN b{k} b ON b.part = v.part) GROUP BY ALL"""
    steps = [f"b0 AS MATERIALIZED (SELECT part, (rank - 1)::BIGINT AS e, x FROM part_of JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rank FROM whole) USING (vec_id) WHERE rank <= {entries})"]
    for k in range(rounds):
        steps.append(f"n{k} AS MATERIALIZED ({near.format(k=k)})")
        steps.append(f"""s{k} AS (SELECT part, best.e AS e, i, sum(x[i]) AS s, count(*)::HUGEINT AS c FROM n{k}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM part_of) + 1)) AS i) GROUP BY 1, 2, 3)""")
        steps.append(f"""b{k + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (SELECT part, e, list(((s - ((s % c) + c) % c) // c)::BIGINT ORDER BY i) AS x FROM s{k} GROUP BY 1, 2) m USING (part, e))""")
    return f"""WITH whole AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({2 ** 12} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part_of AS MATERIALIZED (SELECT vec_id, p AS part, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS x FROM whole, (SELECT unnest(range({parts})) AS p)),
{", ".join(steps)},
f AS ({near.format(k=rounds)}),
c AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM f GROUP BY 1),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN whole USING (vec_id), h"""


def oracle_sql() -> dict[str, str]:
    """Of the joins (by brute force over the small tables), cutting and coding; the other queries are tested against brute force or round trips."""
    return {"op6_jaccard": OP6, "op9_neighbours": OP9, "op11_infill": OP11, "op12_codes": _op12()}
