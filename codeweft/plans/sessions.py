"""Repositories, chats and messages as tables."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweft.functions.metrics import chat_title

REPOS = "repo_id string, name string, source string, status string, last_synced timestamp, created_at timestamp"
CHATS = "chat_id string, repo_id string, title string, created_at timestamp"
MESSAGES = "msg_id string, chat_id string, role string, content string, mode string, trace array<struct<tool:string,args:string>>, is_partial boolean, highlighted_nodes array<string>, created_at timestamp"
STATUSES = ("idle", "indexing", "ready", "error")
NEW_CHAT = "New Chat"


def utcnow() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


def _row(spark: SparkSession, schema: str, **values) -> DataFrame:
    names = [part.strip().split(" ")[0] for part in schema.replace("struct<tool:string,args:string>", "x").split(",")]
    return spark.createDataFrame([tuple(values.get(n) for n in names)], schema)


def new_repo(spark: SparkSession, source: str, name: str, now: datetime | None = None) -> tuple[DataFrame, str]:
    """A row for a repository, and its id."""
    ident = uuid.uuid4().hex
    return _row(spark, REPOS, repo_id=ident, name=name, source=source, status="idle", created_at=now or utcnow()), ident


def create_repo(repos: DataFrame, source: str, name: str, now: datetime | None = None) -> tuple[DataFrame, str]:
    row, ident = new_repo(repos.sparkSession, source, name, now)
    return repos.unionByName(row), ident


def list_repos(repos: DataFrame) -> DataFrame:
    return repos.orderBy(F.desc("created_at"), "repo_id")


def update_repo_status(repos: DataFrame, repo_id: str, status: str, last_synced: datetime | None = None) -> DataFrame:
    """``last_synced`` stays as it is where none is given."""
    if status not in STATUSES:
        raise ValueError(f"unknown status {status!r}")
    mine = F.col("repo_id") == repo_id
    rows = repos.withColumn("status", F.when(mine, status).otherwise(F.col("status")))
    return rows if last_synced is None else rows.withColumn("last_synced", F.when(mine, F.lit(last_synced)).otherwise(F.col("last_synced")))


def find_repo_by_source(repos: DataFrame, source: str) -> DataFrame:
    """The repository of that source: as given, else trimmed, else by the name
    at the end of the path; the first by id of several."""
    trimmed = source.strip()
    name = trimmed.rstrip("/").rsplit("/", 1)[-1]
    tier = F.when(F.col("source") == source, 1).when(F.col("source") == trimmed, 2).when(F.col("name") == name, 3)
    return repos.withColumn("tier", tier).where("tier IS NOT NULL").orderBy("tier", "repo_id").limit(1).drop("tier")


def delete_repo(repos: DataFrame, chats: DataFrame, messages: DataFrame, repo_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All three tables without the repository, its chats and their messages."""
    gone = chats.where(F.col("repo_id") == repo_id).select("chat_id")
    keep = lambda df: df.where(~F.coalesce(F.col("repo_id") == repo_id, F.lit(False)))
    return keep(repos), keep(chats), messages.join(gone, "chat_id", "left_anti")


def new_chat(spark: SparkSession, repo_id: str, title: str = NEW_CHAT, now: datetime | None = None) -> tuple[DataFrame, str]:
    """A row for a chat, and its id."""
    ident = uuid.uuid4().hex
    return _row(spark, CHATS, chat_id=ident, repo_id=repo_id, title=title, created_at=now or utcnow()), ident


def create_chat(chats: DataFrame, repo_id: str, title: str = NEW_CHAT, now: datetime | None = None) -> tuple[DataFrame, str]:
    row, ident = new_chat(chats.sparkSession, repo_id, title, now)
    return chats.unionByName(row), ident


def get_chat(chats: DataFrame, chat_id: str) -> DataFrame:
    return chats.where(F.col("chat_id") == chat_id)


def set_repo(chats: DataFrame, chat_id: str, repo_id: str) -> DataFrame:
    return chats.withColumn("repo_id", F.when(F.col("chat_id") == chat_id, repo_id).otherwise(F.col("repo_id")))


def set_title(chats: DataFrame, chat_id: str, title: str) -> DataFrame:
    return chats.withColumn("title", F.when(F.col("chat_id") == chat_id, title).otherwise(F.col("title")))


def delete_chat(chats: DataFrame, messages: DataFrame, chat_id: str) -> tuple[DataFrame, DataFrame]:
    other = F.col("chat_id") != chat_id
    return chats.where(other), messages.where(other)


def chats_with_repo(chats: DataFrame, repos: DataFrame) -> DataFrame:
    return chats.join(repos.select("repo_id", F.col("name").alias("repo_name")), "repo_id", "left")


def new_message(spark: SparkSession, chat_id: str, role: str, content: str, mode: str = "graph_rag", trace: list | None = None, is_partial: bool = False, highlighted: list[str] | None = None, now: datetime | None = None) -> DataFrame:
    return _row(spark, MESSAGES, msg_id=uuid.uuid4().hex, chat_id=chat_id, role=role, content=content, mode=mode, trace=trace or [], is_partial=is_partial, highlighted_nodes=highlighted or [], created_at=now or utcnow())


def save_message(messages: DataFrame, *args, **more) -> DataFrame:
    """``messages`` and one more; the arguments are those of ``new_message``."""
    return messages.unionByName(new_message(messages.sparkSession, *args, **more))


def list_messages(messages: DataFrame, chat_id: str) -> DataFrame:
    rows = messages.where(F.col("chat_id") == chat_id).orderBy("created_at", "msg_id")
    return rows.withColumns({"trace": F.coalesce("trace", F.array().cast("array<struct<tool:string,args:string>>")), "highlighted_nodes": F.coalesce("highlighted_nodes", F.array().cast("array<string>"))})


def message_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("chat_id").agg(F.count("*").alias("message_count"))


def auto_titles(messages: DataFrame, order: str = "seq") -> DataFrame:
    """``chat_id, title`` from the first message of a user in each chat."""
    first = Window.partitionBy("chat_id").orderBy(order)
    users = messages.where("role = 'user'").withColumn("n", F.row_number().over(first)).where("n = 1")
    return users.select("chat_id", chat_title(F.col("content")).alias("title"))
