"""The corpus pipeline: five stages from raw documents to token ids.

Each stage works on all that its predecessor kept, as a table that was written and is read
again. The first four return the columns of ``documents``.

1. language   documents whose language cannot be told go (null, empty and letterless texts)
2. duplicates one document of each near-duplicate group stays (five-word shingles, 0.8)
3. privacy    personal data in the texts is replaced by its kind in brackets
4. mixing     a sample by source, language and topic weights stays
5. encoding   the ids of each text, with their digests
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.bpe import encoding_stage
from quarry.llm.common import materialize, shared_dir
from quarry.llm.jaccard import jaccard_stage
from quarry.llm.langid import language_stage
from quarry.llm.mixing import mixing_stage
from quarry.llm.pii import pii_stage

STAGES = [
    ("language", language_stage),
    ("duplicates", jaccard_stage),
    ("privacy", pii_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: Language evidence, boosted trees and merge replay have no SQL form; the tests hold the
#: stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where = shared_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), where, name)
    return STAGES[-1][1](spark, docs, sf_dir)
