"""Accounts, registrations, identity lookup and code matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreplane import fixed_values as FV
from scoreplane.functions.scalars import seconds_between, valid_email
from scoreplane.operators.asof import asof_join
from scoreplane.session import checkpoint_dir


def _taken(batch: DataFrame, accounts: DataFrame, col: str, flag: str) -> DataFrame:
    """Left join of a distinct key set: at most one match per row, NULL keys never match."""
    keys = (accounts.where(F.col(col).isNotNull()).select(F.col(col).alias("_tk")).distinct()
            .withColumn(flag, F.lit(True)))
    return (batch.join(keys, F.col(col) == F.col("_tk"), "left").drop("_tk")
                 .withColumn(flag, F.coalesce(F.col(flag), F.lit(False))))


def existing_conflicts(batch: DataFrame, accounts: DataFrame) -> DataFrame:
    """Pre-insert check; e-mail is reported before username."""
    b = _taken(_taken(batch, accounts, "email", "_em"), accounts, "username", "_un")
    reason = F.when(F.col("_em"), "email").when(F.col("_un"), "username")
    return b.withColumn("conflict", reason).drop("_em", "_un")


def register_batch(batch: DataFrame, accounts: DataFrame, order: list[str] | None = None,
                   max_rounds: int | None = None) -> DataFrame:
    """Accepted / rejected (with the violated key) as if inserted one by one in ``order``.

    A request is rejected when its username (checked first, as the unique
    index order reports it) or its non-NULL e-mail is already stored, or is
    taken by an earlier *accepted* request of the batch. Computed in rounds,
    each checkpointed to the shared folder:

    1. undecided requests whose username an accepted request holds are
       rejected ('username'; all repeats of a hot key go in one round);
    2. an undecided request that is the earliest open one for its username and
       whose e-mail an accepted request holds is rejected ('email');
    3. a request that is the earliest undecided one for its username and for
       its e-mail is accepted (grouped ``min``: partial aggregation).

    The earliest undecided request is always decided, so the loop ends; in
    practice after a few rounds (chains of requests linked alternately by
    username and e-mail need more). ``max_rounds`` only guards against
    runaway loops by raising, it never truncates the result.
    """
    order = order or ["ts", "req_id"]
    spark = batch.sparkSession
    checkpoint_dir(spark)
    b = _taken(_taken(batch, accounts, "username", "_un"), accounts, "email", "_em")
    # a stored username decides at once (it is reported first); a stored
    # e-mail only once no earlier same-username request can still be accepted
    s = (b.withColumn("_o", F.struct(*order))
          .withColumn("rejected_for", F.when(F.col("_un"), "username"))
          .withColumn("_state", F.when(F.col("_un"), F.lit("rejected")))
          .drop("_un"))
    rounds = 0
    while True:
        s = s.checkpoint(eager=True)
        if s.where(F.col("_state").isNull()).limit(1).count() == 0:
            break
        rounds += 1
        if max_rounds is not None and rounds > max_rounds:
            raise RuntimeError(f"registration batch not decided after {max_rounds} rounds")
        acc = s.where(F.col("_state") == "accepted")
        und = s.where(F.col("_state").isNull())
        acc_u = acc.select(F.col("username").alias("_au")).distinct().withColumn("_hu", F.lit(True))
        acc_e = (acc.where(F.col("email").isNotNull()).select(F.col("email").alias("_ae")).distinct()
                 .withColumn("_he", F.lit(True)))
        min_u = und.groupBy(F.col("username").alias("_ku")).agg(F.min("_o").alias("_mu"))
        min_e = (und.where(F.col("email").isNotNull()).groupBy(F.col("email").alias("_ke"))
                 .agg(F.min("_o").alias("_me")))
        j = (s.join(acc_u, F.col("username") == F.col("_au"), "left")
              .join(acc_e, F.col("email") == F.col("_ae"), "left")
              .join(min_u, F.col("username") == F.col("_ku"), "left")
              .join(min_e, F.col("email") == F.col("_ke"), "left"))
        undecided = F.col("_state").isNull()
        first_u = F.col("_o") == F.col("_mu")
        # an accepted request with the same username is always earlier and wins
        rej_u = undecided & F.coalesce(F.col("_hu"), F.lit(False))
        # an e-mail clash is final once no earlier same-username request is open
        rej_e = undecided & ~rej_u & first_u & (F.col("_em") | F.coalesce(F.col("_he"), F.lit(False)))
        earliest = (undecided & ~rej_u & ~rej_e & first_u
                    & (F.col("email").isNull() | (F.col("_o") == F.col("_me"))))
        s = j.select(
            *[c for c in s.columns if c not in ("_state", "rejected_for")],
            F.when(rej_u, "username").when(rej_e, "email").otherwise(F.col("rejected_for")).alias("rejected_for"),
            F.when(rej_u | rej_e, "rejected").when(earliest, "accepted").otherwise(F.col("_state")).alias("_state"))
    return s.withColumn("accepted", F.col("_state") == "accepted").drop("_state", "_o", "_em")


def new_accounts(decided: DataFrame, accounts: DataFrame) -> DataFrame:
    """Append accepted requests (``decided`` as ``register_batch`` returns it) with ids after the max.

    Ids follow (ts, req_id); ``tables.assign_ids`` numbers them without a
    single-partition window.
    """
    from scoreplane.operators.tables import assign_ids

    acc = decided.where("accepted").select("username", "email", "ts", "req_id")
    # ``decided`` comes from the checkpointed final round of register_batch
    return assign_ids(acc, accounts, "id", ["ts", "req_id"], materialize=False).select("id", "username", "email")


def resolve_identity(requests: DataFrame, accounts: DataFrame, ident: str = "identifier") -> DataFrame:
    """Match on e-mail when the identifier contains '@', else on username."""
    by_mail = accounts.where(F.col("email").isNotNull()).select(
        F.col("email").alias("_key"), F.col("username").alias("matched_username"))
    by_name = accounts.select(F.col("username").alias("_key"), F.col("username").alias("matched_username"))
    is_mail = F.col(ident).contains("@")
    a = requests.where(is_mail).join(by_mail, F.col(ident) == F.col("_key"), "left").drop("_key")
    b = requests.where(~is_mail | F.col(ident).isNull()).join(
        by_name, F.col(ident) == F.col("_key"), "left").drop("_key")
    return a.unionByName(b)


def update_column(table: DataFrame, updates: DataFrame, key: str, col: str,
                  ts: str | None = None) -> DataFrame:
    """I8: set ``col`` from ``updates`` by key (latest update wins); flag changed rows."""
    u = updates
    if ts:
        u = u.groupBy(key).agg(F.max_by(F.col(col), F.struct(ts, col)).alias("_new"))
    else:
        u = u.groupBy(key).agg(F.max(col).alias("_new"))
    j = table.join(u.withColumnRenamed(key, "_uk"), F.col(key) == F.col("_uk"), "left")
    changed = F.col("_uk").isNotNull() & ~F.col(col).eqNullSafe(F.col("_new"))
    return (j.withColumn("changed", changed)
             .withColumn(col, F.when(F.col("_uk").isNotNull(), F.col("_new")).otherwise(F.col(col)))
             .drop("_uk", "_new"))


def email_check(df: DataFrame, col: str = "email") -> DataFrame:
    """Format flag per row."""
    return df.withColumn("email_valid", F.coalesce(valid_email(col), F.lit(False)))


def match_codes(events: DataFrame, ttl_seconds: float = FV.CODE_TTL_SECONDS) -> DataFrame:
    """Each attempt against the user's latest outstanding issued code.

    Outcome per attempt: 'no_pending' (no issue before it, or the issue was
    already used up by an earlier success or expiry), 'expired' (elapsed >
    ttl; exactly ttl is still valid; expiry is tested before the code),
    'invalid' (wrong code, issue stays open) or 'ok'.
    """
    issues = events.where(F.col("kind") == "issue").select("user_id", "ts", "code")
    attempts = events.where(F.col("kind") == "attempt").select("event_id", "user_id", "ts", "code")
    m = asof_join(attempts, issues, "user_id", "ts", "event_id", ["ts", "code"], prefix="issue_")
    elapsed = seconds_between("issue_ts", "ts")
    raw = (F.when(F.col("issue_ts").isNull(), "no_pending")
           .when(elapsed > ttl_seconds, "expired")
           .when(F.col("code") != F.col("issue_code"), "invalid")
           .otherwise("ok"))
    m = m.withColumn("_raw", raw)
    # an issue is used up by its first 'ok' or 'expired' attempt
    used = (m.where(F.col("_raw").isin("ok", "expired"))
            .groupBy(F.col("user_id").alias("_u"), F.col("issue_ts").alias("_it"))
            .agg(F.min(F.struct("ts", "event_id")).alias("_used")))
    j = m.join(used, (F.col("user_id") == F.col("_u")) & (F.col("issue_ts") == F.col("_it")), "left")
    after = F.col("_used").isNotNull() & (F.struct("ts", "event_id") > F.col("_used"))
    return j.select("event_id", "user_id", "ts", "code", "issue_ts",
                    F.when(after, "no_pending").otherwise(F.col("_raw")).alias("outcome"))
