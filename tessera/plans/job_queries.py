"""The jobs as queries: each runs twice into a new folder, and the output is read back as it stands then."""

from __future__ import annotations

import uuid

from jobs import index_documents, pack_evidence

from ..functions import text as t
from ..operators import shared
from . import bindings as b
from .lookup_queries import _any
from .search_queries import _DOCS, _POST, _Q


def _folder(spark, name: str) -> str:
    return f"{shared.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_index_documents(spark, sf):
    at = _folder(spark, "job1")
    for _ in range(2):
        index_documents.run(spark, f"{sf}/documents.parquet", f"{at}/index", f"{at}/checkpoint")
    return index_documents.postings(spark, f"{at}/index")


_SYMBOLS = """symbols AS (SELECT CAST(doc_id AS VARCHAR) AS id, concat_ws('/', source, lang) AS name, concat_ws('/', source, lang) AS qualname, concat_ws('/', source, lang) AS path, false AS is_test, text AS source
 FROM documents WHERE doc_id IS NOT NULL)"""
INDEX = f"WITH {_SYMBOLS}, {_DOCS}, {_POST} SELECT id, term, CAST(dl AS INTEGER) AS dl, CAST(tf_identity AS BIGINT) AS tf_identity, CAST(tf_body AS BIGINT) AS tf_body FROM post"


def job2_pack_evidence(spark, sf):
    at = _folder(spark, "job2")
    for _ in range(2):
        pack_evidence.run(spark, f"{sf}/benchmark.parquet", f"{sf}/documents.parquet", f"{at}/packs")
    return pack_evidence.read(spark, f"{at}/packs")


PACKS = f"""WITH RECURSIVE {_SYMBOLS}, {b.TASKS}, {_DOCS}, {_Q}, {_POST}, w AS (SELECT count(*) AS n, avg(dl) AS a FROM dl), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
s AS (SELECT task_id, id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (8.0::DOUBLE * tf_identity + tf_body) * 2.2::DOUBLE / ((8.0::DOUBLE * tf_identity + tf_body) + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / a))), 3) AS score
 FROM tt JOIN post USING (term) JOIN df USING (term), w GROUP BY task_id, id),
bm AS (SELECT task_id, id, score, CAST(row_number() OVER (PARTITION BY task_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 20),
o AS (SELECT bm.*, octet_length(encode(coalesce(source, ''))) AS bytes, coalesce(source, '') AS body FROM bm JOIN symbols USING (id)),
f AS (SELECT task_id, id, rank, CASE WHEN bytes <= 20000 THEN bytes ELSE 0 END AS used, bytes <= 20000 AS included FROM o WHERE rank = 1
 UNION ALL SELECT o.task_id, o.id, o.rank, CASE WHEN f.used + o.bytes <= 20000 THEN f.used + o.bytes ELSE f.used END, f.used + o.bytes <= 20000 FROM f JOIN o ON o.task_id = f.task_id AND o.rank = f.rank + 1),
i AS (SELECT task_id, CASE WHEN {_any(t.EDIT_WORDS)} THEN 'edit' WHEN {_any(t.IMPACT_WORDS)} THEN 'impact' WHEN {_any(t.TEST_WORDS)} THEN 'test' ELSE 'understand' END AS intent FROM tasks)
SELECT o.task_id, o.id, o.score, o.rank, CAST(o.bytes AS INTEGER) AS bytes, included, CASE WHEN included THEN body END AS text, intent FROM o JOIN f ON f.task_id = o.task_id AND f.rank = o.rank JOIN i ON i.task_id = o.task_id"""

QUERIES = {f.__name__: f for f in (job1_index_documents, job2_pack_evidence)}
ORACLES = {"job1_index_documents": INDEX, "job2_pack_evidence": PACKS}
