"""The corpus pipeline over ``documents``: each stage is written as Parquet and read again by the next.

Quality rules reject documents; of each group of near-duplicates the smallest doc_id stays; long runs that an
earlier document has are cut out; documents with benchmark items go; the rest is tokenised. All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from siftlode.llm import bpe, decontaminate, neardup, quality, substring
from siftlode.llm.shared import written

STAGES = [
    ("quality rules", quality.stage),
    ("near-dedup", neardup.stage),
    ("substring dedup", substring.stage),
    ("decontamination", decontaminate.stage),
    ("tokenisation", bpe.stage),
]

#: SQL cannot express the fingerprints and the merges; tests/llm/test_pipeline_whole.py holds run() against the
#: same stages by plain means (SQL, sets and loops).
ORACLE_SQL = None


def run(spark, sf_dir: str):
    """The stages applied to ``documents``, each over all rows that its predecessor kept.

    Null, empty and wordless texts fail the quality rules. Of repeated rows one stays. Other columns pass through,
    whatever their names but ids, n_tokens and round_trip, which the last stage adds. Empty tables give an empty
    result. The stages' tables stay in the shared folder, where the last one is read from.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
