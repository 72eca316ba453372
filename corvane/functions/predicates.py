"""Reusable predicates. Three-valued logic is kept: a null test is not a failed one."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# States of a request that is not decided.
APPLYING = ["PENDING_L1", "PENDING_L2", "REJECTED_L1", "REJECTED_L2"]


def _status() -> Column:
    return F.col("whitelist_status")


def wl_approved() -> Column:
    return (F.col("is_whitelist") == 1) | (_status() == "APPROVED")


def wl_applying() -> Column:
    return (F.col("is_whitelist") == 0) & _status().isin(APPLYING)


def plain() -> Column:
    return (F.col("is_whitelist") == 0) & (_status().isNull() | ~_status().isin(*APPLYING, "APPROVED"))


def wl_active() -> Column:
    return wl_approved() | wl_applying()


def in_env(env: str) -> Column:
    """Rows of the environment, and those that name none."""
    return F.coalesce("env", F.lit("")).isin("", env)


def showable(pool: bool = False) -> Column:
    """Has an error, or an analysis that is done, pending or failed; the pool also admits rows
    not analysed yet."""
    out = F.coalesce(F.col("explain_error") != "", F.lit(False)) | F.coalesce(F.col("llm_status").isin("DONE", "PENDING", "FAILED"), F.lit(False))
    return out | (F.col("explain_error").isNull() & F.col("rating").isNull()) if pool else out


def scope(name: str, part: str = "all") -> Column:
    """plain, or wl with applying, approved, rejected (REJECTED_L1 only) or all."""
    if name == "plain":
        return plain()
    parts = {"applying": wl_applying(), "approved": wl_approved(), "rejected": _status() == "REJECTED_L1", "all": wl_active()}
    return parts[part]


def status_alias(column: str, wanted: str) -> Column:
    """X_OR_Y asks for either."""
    return F.col(column).isin(wanted.split("_OR_"))


def every(tests: Iterable[tuple[str, str | None]]) -> Column:
    """column = value for each value given; blank values ask for nothing, others are trimmed."""
    wanted = [F.col(c) == v.strip() for c, v in tests if v and v.strip()]
    return reduce(lambda a, b: a & b, wanted, F.lit(True))


def to_do(role: str, user: str, status: str | None = None) -> Column:
    """Requests for a user as l1, l2, applicant or any of them."""
    columns = {"l1": ["l1_approver"], "l2": ["l2_approver"], "applicant": ["applicant"], "any": ["l1_approver", "l2_approver", "applicant"]}[role]
    mine = reduce(lambda a, b: a | b, (F.col(c) == user for c in columns))
    return mine & (F.col("status") == status) if status else mine


def mine_to_approve(user: str, slow: bool = False) -> Column:
    """Waiting for the user at their level; for slow statements a second rejection waits too."""
    first = F.col("status").isin("PENDING_L1", *(["REJECTED_L2"] if slow else [])) & (F.col("l1_approver") == user)
    return first | ((F.col("status") == "PENDING_L2") & (F.col("l2_approver") == user))


def current_approver(names: list[str], part: str | None = None) -> Column:
    """The approver whose turn it is, by list or by part of the name."""
    by = (lambda c: F.col(c).contains(part)) if part else (lambda c: F.col(c).isin(names))
    return (F.col("status").isin("PENDING_L1", "REJECTED_L2") & by("l1_approver")) | ((F.col("status") == "PENDING_L2") & by("l2_approver"))


def wanted_file(path: str, extensions: list[str], denied: list[str]) -> Column:
    """Files of these extensions, in any case, and always xml, outside the denied prefixes; without
    extensions all. Blank paths are not wanted."""
    p = F.trim(path)
    open_ = reduce(lambda a, d: a & ~p.startswith(d), denied, p != "")
    if not extensions:
        return open_
    extension = F.when(p.contains("."), F.lower(F.substring_index(p, ".", -1))).otherwise("")
    return open_ & extension.isin(*{*(e.lower() for e in extensions), "xml"})


def included_package(package: str, prefixes: str) -> Column:
    """Packages that begin with one of the comma-separated prefixes; a null or blank one does not."""
    p = F.coalesce(F.col(package), F.lit(""))
    return (F.trim(p) != "") & reduce(lambda a, x: a | p.startswith(x.strip()), prefixes.split(","), F.lit(False))


# The domains whose tables are shown.
DOMAINS = ["deposit", "loan", "public", "settlement", "platform"]


def allowed_domain(domain: str, domains: list[str] = DOMAINS) -> Column:
    return F.coalesce(F.col(domain).isin(*domains), F.lit(False))
