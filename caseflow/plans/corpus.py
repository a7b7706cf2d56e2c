"""The case corpus the registered queries read: every row of ``documents`` under a generated case header.

``documents`` holds prose without case fields, so each text gets header lines whose kind depends on its id.  The SQL text
runs unchanged on Spark and on the checking engine.  Every fourth document repeats the id of the one before, so the number
of cases grows with the table and each fourth write is a re-add.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import spread

_NL = "chr(10)"


def _lines(test: str, *texts: str) -> str:
    return f"CASE WHEN {test} THEN " + " || ".join(f"{_NL} || {t}" for t in texts) + " ELSE '' END"


def _digits(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


_MD5 = f"md5({_digits('doc_id')})"
_GUID = " || '-' || ".join(f"substr({_MD5},{a},{n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
_BS = "chr(92)"

HEADER = " || ".join([
    f"CASE WHEN doc_id % 7 = 3 THEN '' ELSE 'ICM-' || "
    f"{_digits('600000000 + doc_id - CASE WHEN doc_id % 4 = 3 THEN 1 ELSE 0 END')} || ': ' END",
    "CASE doc_id % 6 WHEN 0 THEN 'AMA timeout on Windows server' WHEN 1 THEN 'Linux connection failure in East US' "
    "WHEN 2 THEN 'Azure storage latency issue seen by customer' WHEN 3 THEN 'Telegraf InfluxDb writer stopped' "
    "WHEN 4 THEN 'short' ELSE 'MetricsExtension version 1.35 crash' END",
    _lines("doc_id % 14 = 3", f"'Incident-' || {_digits('10000000 + doc_id')}",
           f"'Support Request Number: ' || {_digits('2400000000 + doc_id')}"),
    _lines("doc_id % 14 = 10", f"'Support:' || {_digits('doc_id')}", "'Ticket: AB12CD34'"),
    _lines("doc_id % 3 = 0", f"'Subscription ID: ' || {_GUID}"),
    _lines("doc_id % 10 = 4", f"'Workspace ID: ' || {_GUID}"),
    _lines("doc_id % 4 = 1", f"'Agent version: 1.' || {_digits('doc_id % 40')}", "'Major OS Version: Windows 11 Pro '"),
    _lines("doc_id % 5 = 2", "'Symptoms: agent stops sending data'", "'Problem: short'"),
    _lines("doc_id % 13 = 5", "'--- ADDITIONAL notes for the on-call engineer'", "'ADDITIONAL INFORMATION follows below here'"),
    _lines("doc_id % 2 = 0", "'2024-01-01T00:00:00.000 TID:7 Error writing to socket'",
           "'2024-01-01T00:00:01.000 TID:8 Error writing to socket'",
           f"'StorageException on vm-prod-' || {_digits('doc_id % 10')}"),
    _lines("doc_id % 10 = 0", "'Failed to open a'", "'Failed to open a'", "'  Failed to open b  '", "'Failed to open c'",
           "'Failed to open d'"),
    _lines("doc_id % 5 = 0",
           "'Owner ops.team@corp.com and ops.team@corp.com, j-doe@microsoft.com, call 555-123-4567'"),
    _lines("doc_id % 5 = 1",
           f"'/subscriptions/' || '0a1b2c3d-0000-1111-2222-' || substr({_MD5},1,12) || '/resourceGroups/rg-' || "
           f"{_digits('doc_id % 9')} || '/providers/Microsoft.Compute/virtualMachines'"),
    _lines("doc_id % 5 = 3", f"{_BS} || {_BS} || 'srv' || {_BS} || 'share'",
           f"'C:' || {_BS} || 'Users' || {_BS} || 'joe' || {_BS} || 'a.log;'",
           f"'HKEY_LOCAL_MACHINE' || {_BS} || 'Soft.ware'"),
    _lines("doc_id % 5 = 4", f"'server=db' || {_digits('doc_id % 3')} || '.corp;database=main1'"),
    _lines("doc_id % 8 = 1",
           "'Customer contact John Smith Doe from account AB12CD34EF, secret abcdefghij0123456789XYZ'"),
    _lines("doc_id % 8 = 5", "'Mary Jones wrote REF1234567 and KB50012 in Build A1B2C3D4E5'"),
    _lines("doc_id % 12 = 7", f"'Node ' || chr(233) || '10.0.0.7 and .a.@b-c.de. or -x-@host.example.org.'"),
    _lines("doc_id % 9 = 4", "'Jane Doe'", "'Note Submitted at 2024-02-03 10:11:12'", "'Bob Ray'",
           "'Reply Submitted at 2024-02-03 11:12:13 by mail'"),
    _lines("doc_id % 7 = 2", f"'See Work Item 12345678 and WI ' || {_digits('7000000 + doc_id % 50')} || ', #998877'"),
    _lines("doc_id % 17 = 6", "'Quoted token [EMAIL_1] from an earlier export'"),
    f"{_NL} || text",
])

COLUMNS = {
    "source": f"'src' || {_digits('doc_id % 4')}",
    "ingest_seq": "doc_id",
    "given_case_id": f"CASE WHEN doc_id % 19 = 7 THEN 'MANUAL-' || {_digits('doc_id - doc_id % 2')} END",
    "content": HEADER,
}

SQL = "SELECT " + ", ".join(f"{expr} AS {name}" for name, expr in COLUMNS.items()) + " FROM documents"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, ingest_seq, given_case_id, content, ts), one row per document."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return documents.selectExpr(
        *[f"{expr} AS {name}" for name, expr in COLUMNS.items()],
        "timestamp_seconds(1704067200 + doc_id) AS ts")
