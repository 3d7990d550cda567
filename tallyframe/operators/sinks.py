"""Writing results: versions by key, an audit that only grows, and reports that are refused until they tie out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import ledger, reports
from tallyframe.operators.documents import latest
from tallyframe.operators.ledger import entry_audit, trial_balance
from tallyframe.session import checkpointed


def append_audit(events: DataFrame, path: str) -> None:
    """Events are added, never changed; partitioned by the month they were written in."""
    events.withColumn("written", F.date_format(F.current_timestamp(), "yyyy-MM")).write.mode("append").partitionBy("written").parquet(path)


def upsert(known: DataFrame, fresh: DataFrame, path: str, *, key: str = "file_hash", rev: str = "rev") -> None:
    """The last version of each key of both, written to a new place, so that readers of the old one are not disturbed."""
    latest(known.unionByName(fresh), key, rev).write.mode("errorifexists").parquet(path)


class NotIssued(ValueError):
    pass


def write_statements(lines: DataFrame, chart: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Cover, statements, checks, balances and an entry trace as tables under `path`; refused while a check fails."""
    checks = reports.tie_out_checks(lines, chart)
    row = checks.first()
    if not row["can_issue"]:
        raise NotIssued("failed: " + ", ".join(k for k in ("e1", "e2", "e3", "e4", "e6") if not row[k]))
    sheets = {
        "income_statement": reports.income_statement(lines, chart), "balance_sheet": reports.balance_sheet(lines, chart), "cash_flow": reports.cash_flow_direct(lines), "cash_flow_indirect": reports.cash_flow_indirect(lines, chart),
        "checks": checks, "account_balances": trial_balance(lines), "entries": entry_audit(lines),
    }
    for name, df in sheets.items():
        df.write.mode("overwrite").format(fmt).option("header", True).save(f"{path}/{name}")


def write_documents(documents: DataFrame, path: str, fmt: str = "parquet") -> None:
    """documents(doc_id, ..., line_items, payments, issues: arrays of structs) as a summary and a table per array."""
    arrays = [f.name for f in documents.schema if f.dataType.typeName() == "array" and f.dataType.elementType.typeName() == "struct"]
    documents.drop(*arrays).write.mode("overwrite").format(fmt).option("header", True).save(f"{path}/summary")
    for name in arrays:
        each = documents.select("doc_id", F.posexplode(name).alias("n", "x")).select("doc_id", "n", "x.*")
        each.write.mode("overwrite").format(fmt).option("header", True).save(f"{path}/{name}")


def post_journal(lines: DataFrame, path: str) -> int:
    """Appends entries and their lines under the path, lines first, so that an entry in the headers has all its lines; how many were posted.

    Entries that do not balance, or are there already, are left out.  Lines are partitioned by period; one writer at a time."""
    spark = lines.sparkSession
    audit = ledger.entry_audit(lines).where("balanced").select("entry_id")
    known = _read(spark, f"{path}/entries")
    fresh = audit if known is None else audit.join(known.select("entry_id"), "entry_id", "left_anti")
    rows = checkpointed(lines.join(fresh, "entry_id", "left_semi").withColumn("period", ledger.period(F.col("entry_date"))))
    heads = rows.groupBy("entry_id").agg(F.min("entry_date").alias("entry_date"), F.min("source_kind").alias("source_kind"), F.min("source_id").alias("source_id"), F.min("period").alias("period"), F.count("*").alias("n_lines"))
    n = heads.count()
    if n:
        rows.write.mode("append").partitionBy("period").parquet(f"{path}/lines")
        heads.write.mode("append").parquet(f"{path}/entries")
    return n


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None
