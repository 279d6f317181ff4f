"""Who is behind a user name, as far as the masked accounts tell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.functions.scalars import classify_account

PERSON_COLUMNS = ("account_type", "degree", "entry_year", "dept_code")


def build_registry(
    requests: DataFrame, user: str = "username", account: str = "user_account", ts: str = "ts_local"
) -> DataFrame:
    """One row per user: accounts by use, attributes of the first account that is a person's.

    Requests shrink to (user, account) counts first; a user's few accounts are then ranked by
    requests, and by name on ties.
    """
    per_account = (
        requests.where(F.col(user).isNotNull())
        .groupBy(user, account)
        .agg(F.count("*").alias("_n"), F.min(ts).alias("_from"), F.max(ts).alias("_to"))
        .withColumn("_class", classify_account(F.col(account)))
    )
    known = F.col(account).isNotNull()
    rank = F.struct(-F.col("_n"), F.col(account).alias("account"))
    person = known & (F.col("_class.account_type") != "service")
    ranked = F.array_sort(F.collect_list(F.when(known, rank)))
    grouped = per_account.groupBy(user).agg(
        F.coalesce(
            F.min_by("_class", F.when(person, rank)), F.min_by("_class", F.when(known, rank))
        ).alias("_class"),
        F.array_join(F.transform(ranked, lambda r: r["account"]), ";").alias("account_masked"),
        F.min("_from").alias("first_seen"),
        F.max("_to").alias("last_seen"),
        F.sum("_n").alias("n_requests"),
        F.count(account).alias("n_accounts"),
    )
    return grouped.select(
        user,
        "_class.account_type",
        "account_masked",
        "_class.degree",
        "_class.entry_year",
        "_class.dept_code",
        "first_seen",
        "last_seen",
        "n_requests",
        "n_accounts",
    )


def registry_report(registry: DataFrame) -> DataFrame:
    """(account_type, n_users, n_multi_account): users by type and those with several accounts."""
    return registry.groupBy("account_type").agg(
        F.count("*").alias("n_users"), F.count_if(F.col("n_accounts") > 1).alias("n_multi_account")
    )
