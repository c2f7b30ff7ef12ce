"""Documents as a service that answers in pages."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from groundspark.plans.registry import query, table
from groundspark.session import shared_folder
from groundspark.sources import paged

SIZE = 100


@query(f"""WITH d AS (SELECT doc_id, lang, n_chars, coalesce(source, 'none') AS query, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents)
SELECT query, CAST(n // {SIZE} AS INTEGER) AS page, CAST(n % {SIZE} AS INTEGER) AS position, CAST(nullif(n // {SIZE}, 0) AS VARCHAR) AS cursor, doc_id, lang, n_chars FROM d""")
def t_paged_documents(spark, sf_dir):
    """Documents written as pages by source and read back, from cursor to cursor."""
    folder = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    paged.write_pages(d, "source", ["doc_id"], SIZE, folder)
    sources = [r[0] for r in d.select(F.coalesce("source", F.lit("none"))).distinct().collect()]  # a query each
    spark.dataSource.register(paged.PagedSource)
    read = spark.read.format("paged").options(fetch="groundspark.sources.paged:saved_page", folder=folder, queries=json.dumps(sorted(sources))).load()
    return read.select("query", "page", "position", "cursor", F.from_json("record", "doc_id long, lang string, n_chars long").alias("r")).select("query", "page", "position", "cursor", "r.*")
