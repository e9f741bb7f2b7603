"""Typed statuses. One struct type for every outcome, so that gates compile into one CASE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rosterfold.functions import messages as text

# Status codes.
OK, INVALID_ARGUMENT, NOT_FOUND, ALREADY_EXISTS, FAILED_PRECONDITION, ABORTED = 0, 3, 5, 6, 9, 10

# Name of the service put into error details; callers pass their own.
DOMAIN = "directory"

_VIOLATIONS = "array<struct<field:string,description:string>>"
_PRECONDITION = "array<struct<type:string,subject:string,description:string>>"


def _text(value: Column | str | None) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("string")


def status(code: int, message: Column | str, *, violations: Column | None = None,
           reason: Column | str | None = None, domain: str | None = None,
           metadata: Column | None = None, precondition: Column | None = None) -> Column:
    def typed(value: Column | None, kind: str) -> Column:
        return (F.lit(None) if value is None else value).cast(kind)

    return F.struct(
        F.lit(code).alias("code"),
        _text(message).alias("message"),
        typed(violations, _VIOLATIONS).alias("violations"),
        _text(reason).alias("reason"),
        _text(domain).alias("domain"),
        typed(metadata, "map<string,string>").alias("metadata"),
        typed(precondition, _PRECONDITION).alias("precondition"))


def ok(message: str | Column) -> Column:
    return status(OK, message)


def violation(field: str, description: Column | str) -> Column:
    return F.struct(F.lit(field).alias("field"), _text(description).alias("description"))


def bad_request(violations: Column) -> Column:
    return status(INVALID_ARGUMENT, text.INVALID, violations=violations)


def not_found(message: Column) -> Column:
    return status(NOT_FOUND, message)


def error_info(code: int, message: str, reason: Column | str, key: str, value: Column,
               domain: str = DOMAIN) -> Column:
    return status(code, message, reason=reason, domain=domain, metadata=F.create_map(F.lit(key), value))


def failed_precondition(kind: str, subject: str, description: str) -> Column:
    return status(FAILED_PRECONDITION, "", precondition=F.array(F.struct(
        F.lit(kind).alias("type"), F.lit(subject).alias("subject"), F.lit(description).alias("description"))))


def stale_etag(provided: Column, domain: str = DOMAIN) -> Column:
    return error_info(ABORTED, text.STALE, text.STALE_REASON, "providedEtag", provided, domain)


FLAT_STATUS = ["code", "message", "violation_fields", "violation_texts", "reason", "detail", "precondition"]


def flat_status(df: DataFrame, *others: str) -> DataFrame:
    """The status as scalar columns beside the named ones, for reports and comparisons."""
    entry = F.map_entries("status.metadata")
    return df.select(
        *others,
        F.col("status.code").alias("code"),
        F.col("status.message").alias("message"),
        F.array_join("status.violations.field", ",").alias("violation_fields"),
        F.array_join("status.violations.description", ",").alias("violation_texts"),
        F.col("status.reason").alias("reason"),
        F.array_join(F.transform(entry, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("detail"),
        F.array_join("status.precondition.type", ",").alias("precondition"))
