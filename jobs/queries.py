"""The jobs as registered queries: each runs twice into one new folder and returns the whole output after the second run."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from memlake.operators import classify
from memlake.plans import catalogue
from memlake.session import shared_folder

from . import mine_documents, sweep_conversations


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_mine_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "job1")
    mine_documents.run(spark, f"{sf_dir}/documents.parquet", folder)
    return mine_documents.run(spark, f"{sf_dir}/documents.parquet", folder)


def job2_sweep_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "job2")
    # A pattern, as a file stream takes folders and patterns, and the table may be one file.
    args = f"{sf_dir}/conversations.parquet*", f"{folder}/output", f"{folder}/checkpoint"
    sweep_conversations.run(spark, *args)
    return sweep_conversations.run(spark, *args)


MINED = f"""WITH c AS ({catalogue._chunks_sql()}), b AS (SELECT doc_id, lang, coalesce(nullif(trim(source), ''), 'unknown') AS wing, {catalogue._class_sql("coalesce(text, '')", classify.TOPICS, 'general')} AS room FROM documents)
 SELECT 'drawer_' || wing || '_' || room || '_' || substring(sha256(wing || '/' || doc_id || chunk_index), 1, 24) AS id, doc_id, chunk_index, wing || '/' || doc_id AS source_file, lang,
 {catalogue._class_sql('chunk', classify.HALLS, 'general')} AS hall, chunk AS document, wing, room FROM c JOIN b ON b.doc_id = c.id"""

SWEPT = f"""WITH j AS (SELECT *, CASE WHEN conv_id IS NULL OR turn IS NULL THEN 'place' WHEN role IS NULL OR role NOT IN ('user', 'assistant') THEN 'role' WHEN text IS NULL OR NOT regexp_matches(text, '\\S') THEN 'blank' END AS reason FROM conversations),
 m AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS n FROM j WHERE reason IS NULL),
 r AS (SELECT DISTINCT conv_id, turn, role, text, reason FROM j WHERE reason IS NOT NULL)
 SELECT 'sweep_' || conv_id || '_' || turn AS id, conv_id, turn, role, text AS document, {catalogue._class_sql('text', classify.HALLS, 'general')} AS hall, {catalogue._class_sql('text', classify.TOPICS, 'general')} AS room, CAST(NULL AS VARCHAR) AS reason FROM m WHERE n = 1
 UNION ALL SELECT sha256('{{"conv_id":' || coalesce(CAST(conv_id AS VARCHAR), 'null') || ',"turn":' || coalesce(CAST(turn AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || ',"text":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || '}}'),
 conv_id, turn, role, text, NULL, NULL, reason FROM r"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_mine_documents, job2_sweep_conversations)}


def oracle_sql() -> dict[str, str]:
    return {"job1_mine_documents": MINED, "job2_sweep_conversations": SWEPT}
