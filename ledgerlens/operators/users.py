"""User and session tables as batch jobs.

Stored tables are laid out for what is asked of them: sessions in folders by the day they expire, so a
purge touches expired days only; both tables sorted by their lookup key with Bloom filters, so a point
lookup skips files and row groups.

Credentials (password length, hashing, tokens) are not modelled: they are online
transaction logic, not data work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Allowed roles, the default role, session lifetime and rejection messages.
ROLES = ["viewer", "analyst", "admin"]
DEFAULT_ROLE = "viewer"
SESSION_DAYS = 7
MSG_INVALID_EMAIL = "Invalid email address."
MSG_EMAIL_EXISTS = "Email already exists."


def expiry(created_at: F.Column) -> F.Column:
    """U4: created + 7 days."""
    return created_at + F.expr(f"INTERVAL {SESSION_DAYS} DAYS")


def screen_signups(requests: DataFrame, users: DataFrame, id_col: str = "request_id") -> DataFrame:
    """Normalise email and role, then reject invalid emails and emails already taken.

    Taken = present in `users` (anti join on the normalised email) or requested earlier in the
    same batch (row_number per email). Checks run in the reference's order.
    """
    email = F.lower(F.trim(F.col("email_raw")))
    role = F.lower(F.trim(F.col("role_raw")))
    r = requests.select(id_col, email.alias("email"),
                        F.when(role.isin(*ROLES), role).otherwise(F.lit(DEFAULT_ROLE)).alias("role"))
    # blank, null and malformed emails are decided here, so they are no join key
    valid = F.coalesce(F.col("email").contains("@"), F.lit(False))
    bad = r.where(~valid).withColumn("reason", F.lit(MSG_INVALID_EMAIL))
    good = r.where(valid)
    existing = users.select(F.lower(F.trim("email")).alias("email")).distinct().withColumn("__taken", F.lit(True))
    # earliest request per email by a partial aggregate (no window over one email's rows)
    first = good.groupBy("email").agg(F.min(id_col).alias("__first"))
    late = F.col("__taken").isNotNull() | (F.col(id_col) != F.col("__first"))
    good = (good.join(existing, "email", "left").join(first, "email")
            .withColumn("reason", F.when(late, F.lit(MSG_EMAIL_EXISTS))))
    out = good.select(id_col, "email", "role", "reason").unionByName(bad.select(id_col, "email", "role", "reason"))
    return out.select(id_col, "email", "role", F.when(F.col("reason").isNull(), "ok").otherwise("rejected").alias("status"),
                      "reason")


def active_sessions(sessions: DataFrame, users: DataFrame, as_of: str) -> DataFrame:
    """Sessions ⋈ users, valid while as_of ≤ expires_at."""
    now = F.lit(as_of).cast(sessions.schema["expires_at"].dataType)
    s = sessions.where(F.col("expires_at") >= now)
    u = users.select(F.col("id").alias("user_id"), "email", "role")
    return s.join(u, "user_id").select("token", "user_id", "email", "role", "expires_at")


def session_for_token(sessions: DataFrame, users: DataFrame, token: str, as_of: str) -> DataFrame:
    """L6 point lookup: one token (a pushed-down equality filter on the session scan)."""
    return active_sessions(sessions.where(F.col("token") == F.lit(token)), users, as_of)


def purge_expired(sessions: DataFrame, as_of: str) -> DataFrame:
    """The session table without expired rows (write it back to replace the old one)."""
    now = F.lit(as_of).cast(sessions.schema["expires_at"].dataType)
    return sessions.where(F.col("expires_at") >= now)


def _sorted_by(df: DataFrame, key: str, distinct: int):
    """A writer of files sorted by `key`, whose row groups carry a Bloom filter of it."""
    return (df.sortWithinPartitions(key).write.option(f"parquet.bloom.filter.enabled#{key}", "true")
            .option(f"parquet.bloom.filter.expected.ndv#{key}", str(distinct)))


def store_sessions(sessions: DataFrame, path: str, mode: str = "append", distinct: int = 100_000) -> None:
    """Sessions in folders by expiry day; `distinct`: about how many tokens a row group holds."""
    dealt = sessions.withColumn("expiry_day", F.to_date("expires_at")).repartitionByRange("expiry_day", "token")
    _sorted_by(dealt, "token", distinct).mode(mode).partitionBy("expiry_day").parquet(path)


def stored_sessions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def store_users(users: DataFrame, path: str, mode: str = "overwrite", distinct: int = 100_000) -> None:
    """Users in files by ranges of their normalised email (`email_key`)."""
    keyed = users.withColumn("email_key", F.lower(F.trim("email")))
    _sorted_by(keyed.repartitionByRange("email_key"), "email_key", distinct).mode(mode).parquet(path)


def user_for_email(users: DataFrame, email: str) -> DataFrame:
    """L6 point lookup on stored users by normalised email (a filter that reaches the files' Bloom filters)."""
    return users.where(F.col("email_key") == F.lit(email.strip().lower())).drop("email_key")


def purge_stored(spark: SparkSession, path: str, as_of: str) -> None:
    """Takes expired sessions out of the store at `path`. Folders of days that are over go, the folder of the day
    of `as_of` is rewritten, and no other file is touched."""
    table = stored_sessions(spark, path)
    now = F.lit(as_of).cast(table.schema["expires_at"].dataType)
    today = F.to_date(now)
    over = [r.expiry_day for r in table.where(F.col("expiry_day") < today).select("expiry_day").distinct().collect()]  # one row a day
    border = table.where((F.col("expiry_day") == today) & (F.col("expires_at") >= now)).checkpoint()  # one day's sessions
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if border.isEmpty():
        over += [r.d for r in spark.range(1).select(today.alias("d")).collect()]
    else:
        _sorted_by(border, "token", 100_000).mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy("expiry_day").parquet(path)
    for day in over:
        gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/expiry_day={day.isoformat()}")
        files.delete(gone, True)


def user_files(manifest: DataFrame, uploads: DataFrame, users: DataFrame) -> DataFrame:
    """S9 `add_file`: attach ingest-manifest rows to the uploading user.

    `uploads` maps `filename` to `user_id`; the result is one row per (user, file) with the
    file metadata as a map, like the user's `files` list.
    """
    u = users.select(F.col("id").alias("user_id"), "email", "role")
    meta = F.create_map(F.lit("rows"), F.col("rows").cast("string"),
                        F.lit("columns"), F.array_join("columns", ","))
    return (manifest.join(uploads.select("filename", "user_id"), "filename")
            .join(u, "user_id")
            .select("user_id", "email", "role", "filename", meta.alias("meta"), "uploaded_at"))
