"""The work ledger as set operations: what is due, what a pass makes of it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def backoff_seconds(attempts):
    """30 seconds, doubled for each attempt after the first."""
    return (30 * F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0)))).cast("long")


def claimable(ledger: DataFrame, needs: DataFrame, now, most_attempts: int = 3, lease_seconds: int = 600) -> DataFrame:
    """Rows to run: pending, failed and due, or running past their lease, with every prerequisite done on the same document.

    needs: feature, prerequisite (few rows).
    """
    age = F.unix_timestamp(F.lit(now)) - F.unix_timestamp("last_attempt")
    due = (F.col("status") == "pending") | ((F.col("status") == "failed") & (F.col("attempts") < most_attempts) & (age >= backoff_seconds(F.col("attempts")))) | ((F.col("status") == "running") & (age >= lease_seconds))
    done = ledger.where("status = 'done'").select(F.col("document_id").alias("_doc"), F.col("feature").alias("_done"))
    unmet = ledger.join(needs, "feature").join(done, (F.col("document_id") == F.col("_doc")) & (F.col("prerequisite") == F.col("_done")), "left_anti")
    return ledger.where(due).join(unmet.select("document_id", "feature").distinct(), ["document_id", "feature"], "left_anti")


def bumped(ledger: DataFrame, versions: DataFrame) -> DataFrame:
    """The ledger after new versions (feature, current): done rows of older versions are pending again, without attempts."""
    old = (F.col("status") == "done") & (F.col("version") < F.col("current"))
    joined = ledger.join(versions, "feature", "left")
    return joined.select("document_id", "feature", F.when(old, F.col("current")).otherwise(F.col("version")).alias("version"), F.when(old, "pending").otherwise(F.col("status")).alias("status"), F.when(old, 0).otherwise(F.col("attempts")).alias("attempts"))


def marked(ledger: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The ledger after outcomes (document_id, feature, outcome): done, failed (once more), reset and requeue (pending, without attempts); the last of equals by name counts."""
    last = outcomes.groupBy("document_id", "feature").agg(F.max("outcome").alias("outcome"))
    joined = ledger.join(last, ["document_id", "feature"], "left")
    again = F.col("outcome").isin("reset", "requeue")
    status = F.when(again, "pending").when(F.col("outcome").isNotNull(), F.col("outcome")).otherwise(F.col("status"))
    attempts = F.when(again, 0).when(F.col("outcome") == "failed", F.col("attempts") + 1).otherwise(F.col("attempts"))
    return joined.withColumn("status", status).withColumn("attempts", attempts.cast("int")).drop("outcome")
