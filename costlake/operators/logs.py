"""Conversations, audit trail and account listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from costlake.operators.costs import page_info, page_of

#: Turns kept for a conversation, turns quoted in a prompt, conversations listed.
HISTORY_TURNS, PROMPT_TURNS, LISTED, PREVIEW = 20, 10, 20, 80


def conversation_history(
    messages: DataFrame, conversation_id: str | None = None, user_id: str | None = None,
    n: int = HISTORY_TURNS,
) -> DataFrame:
    """The newest ``n`` messages of one conversation, or of all, in chronological order.

    The rank filter becomes a limit inside every task before the shuffle, so a conversation holding
    much of the table sends ``n`` rows per task, not its whole history.
    """
    if conversation_id is not None:
        messages = messages.filter(F.col("conversation_id") == conversation_id)
    if user_id is not None:
        messages = messages.filter(F.col("user_id") == user_id)
    newest = Window.partitionBy("conversation_id", "user_id").orderBy(
        F.desc("created_at"), F.desc("role"), F.desc("content")
    )
    kept = messages.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= n)
    return kept.orderBy("conversation_id", "user_id", F.desc("_rank")).drop("_rank")


def conversation_list(
    messages: DataFrame, user_id: str | None = None, limit: int = LISTED
) -> DataFrame:
    """Latest conversations of a user, or of every user.

    The preview is the alphabetically first message, not the earliest.
    """
    asked = messages.filter(F.col("role") == "user")
    if user_id is not None:
        asked = asked.filter(F.col("user_id") == user_id)
    found = asked.groupBy("user_id", "conversation_id").agg(
        F.count("*").alias("message_count"), F.max("created_at").alias("last_message_at"),
        # the smallest prefix is the prefix of the smallest text, and carries less
        F.coalesce(F.min(F.substring("content", 1, PREVIEW)), F.lit("")).alias("preview"),
    )
    order = [F.desc("last_message_at"), F.col("conversation_id")]
    if user_id is not None:
        return found.orderBy(*order).limit(limit)
    ranked = found.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("user_id").orderBy(*order))
    )
    return ranked.filter(F.col("_rank") <= limit).orderBy("user_id", "_rank").drop("_rank")


def prompt_history(messages: DataFrame, turns: int = PROMPT_TURNS) -> DataFrame:
    """The last turns of each conversation as one ``User:/Assistant:`` text."""
    newest = Window.partitionBy("conversation_id", "user_id").orderBy(
        F.desc("created_at"), F.desc("role"), F.desc("content")
    )
    kept = messages.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= turns)
    speaker = F.when(F.col("role") == "user", "User").otherwise("Assistant")
    line = F.struct((-F.col("_rank")).alias("at"),
                    F.concat(speaker, F.lit(": "), F.col("content")).alias("text"))
    return kept.groupBy("conversation_id", "user_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(line)), lambda e: e["text"]), "\n"
        ).alias("history")
    )


def delete_conversation(messages: DataFrame, conversation_id: str, user_id: str) -> DataFrame:
    """The messages that remain once a user's conversation is removed."""
    gone = (F.col("conversation_id") == conversation_id) & (F.col("user_id") == user_id)
    return messages.filter(~gone)


def audit_page(
    log: DataFrame, organization_id: str | None, action: str | None = None, page: int = 1,
    limit: int = 50,
) -> DataFrame:
    """Newest audit events of a tenant."""
    if organization_id is not None:
        log = log.filter(F.col("organization_id") == organization_id)
    if action is not None:
        log = log.filter(F.col("action") == action)
    order = [F.desc("created_at"), "action", "resource_type", "resource_id"]
    return page_of(log, order, page, limit)


def _accounts(accounts, organization_id, provider, is_active):
    for column, value in (("organization_id", organization_id), ("provider", provider),
                          ("is_active", is_active)):
        if value is not None:
            accounts = accounts.filter(F.col(column) == value)
    return accounts


def list_accounts(
    accounts: DataFrame, organization_id: str | None, provider: str | None = None,
    is_active: bool | None = None, page: int = 1, page_size: int = 50,
) -> DataFrame:
    """Newest accounts first."""
    kept = _accounts(accounts, organization_id, provider, is_active)
    return page_of(kept, [F.desc("created_at"), "id"], page, page_size)


def account_pages(
    accounts: DataFrame, organization_id: str | None, provider: str | None = None,
    is_active: bool | None = None, page_size: int = 50,
) -> DataFrame:
    return page_info(_accounts(accounts, organization_id, provider, is_active), page_size)


def duplicate_accounts(accounts: DataFrame) -> DataFrame:
    """Provider accounts registered more than once by a tenant."""
    return accounts.groupBy("organization_id", "provider", "account_id").agg(
        F.count("*").alias("copies")
    ).filter("copies > 1")
