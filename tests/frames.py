"""Small helpers of the tests: times and rows."""

from datetime import datetime, timedelta

DAY = datetime(2024, 1, 1)


def at(minutes: float) -> datetime:
    return DAY + timedelta(minutes=minutes)


def records(df):
    return [tuple(r) for r in df.collect()]
