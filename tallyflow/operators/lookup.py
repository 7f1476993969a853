"""Access paths: what the stored tables are asked for. All are filters that reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_account(accounts: DataFrame) -> DataFrame:
    """The newest version of each account."""
    rest = [c for c in accounts.columns if c != "pubkey"]
    newest = F.max_by(F.struct(*rest), F.struct("timestamp", "write_version"))
    return accounts.groupBy("pubkey").agg(newest.alias("a")).select("pubkey", *[f"a.{c}" for c in rest])


def account_history(accounts: DataFrame, pubkey) -> DataFrame:
    return accounts.where(F.col("pubkey") == F.lit(pubkey)).orderBy(F.desc("timestamp"))


def accounts_by_owner(accounts: DataFrame, owner) -> DataFrame:
    return accounts.where(F.col("owner") == F.lit(owner)).orderBy(F.desc("timestamp"))


def rows_of_slot(df: DataFrame, slot: int) -> DataFrame:
    return df.where(F.col("slot") == slot)


def tx_by_signature(transactions: DataFrame, signature) -> DataFrame:
    return transactions.where(F.col("signature") == F.lit(signature))


def tx_by_program(transactions: DataFrame, programs: DataFrame, program, since, until) -> DataFrame:
    """Transactions of a program in [since, until): the child table is narrowed first."""
    kind = programs.schema["timestamp"].dataType
    own = programs.where((F.col("program_id") == F.lit(program)) & (F.col("timestamp") >= F.lit(since).cast(kind)) & (F.col("timestamp") < F.lit(until).cast(kind)))
    return transactions.join(own.select("timestamp", "signature"), ["timestamp", "signature"], "left_semi")


def slot_children(slots: DataFrame) -> DataFrame:
    """(parent_slot, children, first_child); more than one child is a fork."""
    return slots.where("parent_slot IS NOT NULL").groupBy("parent_slot").agg(F.count(F.lit(1)).alias("children"), F.min("slot").alias("first_child"))


def decoded_by_key(decoded: DataFrame, decoder: str, key: str) -> DataFrame:
    return decoded.where((F.col("decoder_name") == decoder) & (F.col("record_key") == key)).orderBy(F.desc("timestamp"))


def tx_by_signer(transactions: DataFrame, signer) -> DataFrame:
    """Transactions that an account signed, by their ``signers`` array."""
    return transactions.where(F.array_contains("signers", F.lit(signer)))


def tx_by_fee_payer(transactions: DataFrame, payer) -> DataFrame:
    """The first signer pays."""
    return transactions.where(F.get("signers", F.lit(0)) == F.lit(payer))


def co_signers(transactions: DataFrame) -> DataFrame:
    """(signer, other, transactions) for the fee payer and each other signer."""
    payer = F.get("signers", F.lit(0))
    pairs = transactions.select("signature", payer.alias("signer"), F.explode(F.array_distinct("signers")).alias("other")).where("signer <> other")
    return pairs.groupBy("signer", "other").agg(F.count_distinct("signature").alias("transactions"))


def latest_checkpoint(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.groupBy("stream_name").agg(F.max_by(F.struct("last_processed_slot", "last_observed_at", "notes"), "last_observed_at").alias("c")).select("stream_name", "c.*")
