"""Digests of classified tickets per team and per user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redressa.functions.text import escape_html
from redressa.operators.ordering import with_position

PAGE_SIZE = 50
TEAM_SUBJECT = "Complaints assigned to your team"
USER_SUBJECT = "We have received your complaints"
ARRIVAL = ["raised_ts", "ticket_id"]


def with_pages(tickets: DataFrame, key: str, page_size: int = PAGE_SIZE) -> DataFrame:
    """(key, ticket_id, position, page): arrival order within the key, cut into pages.

    A page bounds every list built later, so the default team, which may hold a large part
    of all tickets, is many small groups.
    """
    placed = with_position(tickets.select(key, *ARRIVAL), ARRIVAL, [key])
    page = F.floor((F.col("position") - 1) / page_size) + 1
    return placed.select(key, "ticket_id", "position", page.cast("long").alias("page"))


def group_by_key(tickets: DataFrame, key: str, page_size: int = PAGE_SIZE) -> DataFrame:
    """Ticket ids per key and page in arrival order: (key, page, n, ticket_ids)."""
    ids = F.array_sort(F.collect_list(F.struct("position", "ticket_id")))
    return (
        with_pages(tickets, key, page_size)
        .groupBy(key, "page")
        .agg(F.count(F.lit(1)).alias("n"), ids.alias("ids"))
        .select(key, "page", "n", F.array_join("ids.ticket_id", ",").alias("ticket_ids"))
    )


def first_seen_keys(tickets: DataFrame, key: str) -> DataFrame:
    """Keys with their position by first arrival."""
    firsts = tickets.groupBy(key).agg(F.min(F.struct(*ARRIVAL)).alias("first"))
    return with_position(firsts.select(key, "first.*"), ARRIVAL).select(key, "position")


def _row(*cells: Column) -> Column:
    parts = [F.lit("<tr>")]
    for cell in cells:
        parts += [F.lit("<td>"), escape_html(F.coalesce(cell.cast("string"), F.lit(""))), F.lit("</td>")]
    return F.concat(*parts, F.lit("</tr>"))


def _digest(tickets: DataFrame, key: str, heads: list[str], cells: list[Column], intro: tuple[str, str], closing: str,
            page_size: int) -> DataFrame:
    pages = with_pages(tickets, key, page_size).drop(key)
    # Only ids were put in order; the texts meet them once, spread by ticket.
    rows = tickets.join(pages, "ticket_id").select(key, "page", "position", _row(*cells).alias("row"))
    header = "<tr>" + "".join(f"<th>{head}</th>" for head in heads) + "</tr>"
    body = F.concat(
        F.lit(f"<html><body><p>{intro[0]}"), escape_html(F.coalesce(key, F.lit(""))),
        F.lit(f"{intro[1]}</p><table>{header}"), F.array_join("rows.row", ""),
        F.lit(f"</table><p>{closing}</p></body></html>"),
    )
    listed = F.array_sort(F.collect_list(F.struct("position", "row"))).alias("rows")
    return rows.groupBy(key, "page").agg(listed).select(key, "page", F.size("rows").alias("n"), body.alias("body"))


def team_digest(tickets: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """(team, page, n, body) from (ticket_id, raised_ts, team, severity, complaint_text)."""
    return _digest(
        tickets, "team", ["Ticket", "Complaint", "Severity"],
        [F.col("ticket_id"), F.col("complaint_text"), F.col("severity")],
        ("New complaints for team ", ":"), "Sent by a program; answers are not read.", page_size,
    )


def user_digest(tickets: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """(user_id, page, n, body) from (ticket_id, raised_ts, user_id, complaint_text)."""
    return _digest(
        tickets, "user_id", ["Ticket", "Complaint"], [F.col("ticket_id"), F.col("complaint_text")],
        ("Hello ", ", these complaints of yours have reached us:"),
        "We are sorry for the trouble and will look into it. Sent by a program; answers are not read.", page_size,
    )


def team_address(team: Column, domain: str = "teams.invalid") -> Column:
    return F.concat(F.replace(F.lower(team), F.lit(" "), F.lit("-")), F.lit(f"@{domain}"))


def outbox(tickets: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """All mails of a batch: (recipient, subject, page, body); sending them is left to a mailer."""
    to_teams = team_digest(tickets, page_size).select(
        team_address(F.col("team")).alias("recipient"), F.lit(TEAM_SUBJECT).alias("subject"), "page", "body"
    )
    to_users = user_digest(tickets, page_size).select(
        F.col("user_id").alias("recipient"), F.lit(USER_SUBJECT).alias("subject"), "page", "body"
    )
    return to_teams.unionByName(to_users)
