"""Who sees what: user hierarchy, permissions, notifications and feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanset.functions.scalars import notice_kind, notice_text
from gleanset.operators.skew import lookup

# Slices in which actions meet the admins; each admin is copied this often.
ADMIN_SLICES = 64

def with_username(rows: DataFrame, users: DataFrame, key: str, row_id: str, name: str = "username") -> DataFrame:
    """Inner join of rows to their user; a very active user is spread over tasks."""
    names = users.select(F.col("id").alias(key), F.col("username").alias(name), F.lit(True).alias("__known"))
    return lookup(rows, names, [key]).filter("__known").drop("__known")


def with_managers(users: DataFrame) -> DataFrame:
    """Every user with manager and manager's manager; missing ones stay NULL."""
    def boss(key: str, name: str, above: str) -> DataFrame:
        return users.select(F.col("id").alias(key), F.col("username").alias(name), F.col("manager_id").alias(above))

    first = lookup(users.select("id", "username", "role", "manager_id"), boss("manager_id", "manager", "above"), ["manager_id"])
    second = lookup(first, boss("above", "grand_manager", "top"), ["above"])
    return second.select("id", "username", "role", "manager", "grand_manager")


def visible_users(users: DataFrame) -> DataFrame:
    """(viewer, visible) pairs of everyone but admins, who see all users.

    A manager sees self, own team leads and the users under them; a team lead
    self and own users; others only themselves.
    """
    own = users.select(F.col("id").alias("viewer"), F.col("id").alias("visible"))
    staff = users.select(F.col("manager_id").alias("viewer"), F.col("id").alias("visible"), F.col("role").alias("visible_role"))
    roles = users.select(F.col("id").alias("viewer"), F.col("role").alias("viewer_role"))
    direct = lookup(staff, roles, ["viewer"]).filter(
        ((F.col("viewer_role") == "manager") & (F.col("visible_role") == "team_lead"))
        | ((F.col("viewer_role") == "team_lead") & (F.col("visible_role") == "user"))
    ).select("viewer", "visible", "viewer_role")
    leads = direct.filter("viewer_role = 'manager'").select("viewer", F.col("visible").alias("lead"))
    members = direct.filter("viewer_role = 'team_lead'").select(F.col("viewer").alias("lead"), "visible")
    # a lead has one manager, so this looks up the viewer of every member
    below = lookup(members, leads, ["lead"]).filter("viewer is not null").select("viewer", "visible")
    return own.unionByName(direct.select("viewer", "visible")).unionByName(below).distinct()


def visible_rows(
    rows: DataFrame, users: DataFrame, viewer: int, role: str, key: str = "user_id", row_id: str = "id"
) -> DataFrame:
    """Rows of the users one viewer may see; an admin sees all of them."""
    if role == "admin":
        return rows
    seen = seen_by(users, viewer)
    return rows.join(seen, rows[key] == seen["id"], "left_semi")


def seen_by(users: DataFrame, viewer: int) -> DataFrame:
    """Ids of the users one viewer sees, as in :func:`visible_users`, from each user's two superiors."""
    def superior(key: str, role: str, above: str) -> DataFrame:
        return users.select(F.col("id").alias(key), F.col("role").alias(role), F.col("manager_id").alias(above))

    own = users.select("id", "role", "manager_id")
    first = lookup(own, superior("manager_id", "lead_role", "lead_manager"), ["manager_id"])
    ranked = lookup(first, superior("lead_manager", "top_role", "top_manager"), ["lead_manager"])
    direct = (F.col("manager_id") == viewer) & (
        ((F.col("lead_role") == "manager") & (F.col("role") == "team_lead"))
        | ((F.col("lead_role") == "team_lead") & (F.col("role") == "user"))
    )
    below = (
        (F.col("lead_manager") == viewer) & (F.col("top_role") == "manager")
        & (F.col("lead_role") == "team_lead") & (F.col("role") == "user")
    )
    return ranked.filter((F.col("id") == viewer) | direct | below).select("id")


def role_permissions(roles: DataFrame, grants: DataFrame, permissions: DataFrame) -> DataFrame:
    """Three-table bridge: one row per role and permission."""
    return roles.join(grants, "role_id").join(permissions, "permission_id").select("role", "permission")


def permissions_per_role(pairs: DataFrame) -> DataFrame:
    """Ordered permission list per role; permissions are few by definition."""
    return pairs.groupBy("role").agg(F.array_join(F.array_sort(F.collect_set("permission")), ", ").alias("permissions"))


def notifications(logs: DataFrame, users: DataFrame) -> DataFrame:
    """Notices of export, import and clean actions.

    They go to the actor's manager, or to every other admin if there is none.
    Actions without a manager meet the admins in slices, so neither side is
    gathered in one place, however many admins there are.
    """
    acts = logs.withColumn("action_type", notice_kind(F.col("action"))).filter("action_type is not null")
    actor = users.select(F.col("id").alias("user_id"), "username", "manager_id", F.lit(True).alias("__known"))
    sent = lookup(acts, actor, ["user_id"]).filter("__known").withColumn(
        "message", notice_text(F.col("username"), F.col("action")))
    managed = sent.filter("manager_id is not null").withColumn("recipient_id", F.col("manager_id").cast("bigint"))
    every = F.explode(F.sequence(F.lit(0), F.lit(ADMIN_SLICES - 1)))
    admins = users.filter("role = 'admin'").select(F.col("id").cast("bigint").alias("recipient_id"), every.alias("__slice"))
    orphans = sent.filter("manager_id is null").withColumn("__slice", F.pmod(F.xxhash64("id"), F.lit(ADMIN_SLICES)).cast("int"))
    told = orphans.join(admins, "__slice").filter(F.col("recipient_id") != F.col("user_id"))
    columns = ["id", "recipient_id", F.col("user_id").alias("sender_id"), "message", "action_type"]
    return managed.select(*columns).unionByName(told.select(*columns))


def inbox(requests: DataFrame, key_requests: DataFrame, notices: DataFrame) -> DataFrame:
    """One feed of requests, key requests and notifications."""
    def part(rows: DataFrame, kind: str, stamp: str, text: str):
        return rows.select(F.lit(kind).alias("type"), "id", F.col(stamp).alias("timestamp"), F.col(text).cast("string").alias("detail"))

    return (
        part(requests, "request", "requested_at", "status")
        .unionByName(part(key_requests, "api_key_request", "created_at", "status"))
        .unionByName(part(notices, "notification", "created_at", "message"))
    )


def newest_first(feed: DataFrame) -> DataFrame:
    return feed.orderBy(F.desc_nulls_last("timestamp"), "type", "id")
