import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from snaplens import Roles, local_session  # noqa: E402

GOLDEN_SCHEMA = (
    "`Id` string, `OpportunityName` string, `Snapshot Date` timestamp_ntz, `Created` timestamp_ntz, `Stage` string, "
    "`SellPrice` bigint, `GM%` double, `BusinessUnit` string, `Owner` string"
)


def day(text):
    return None if text is None else datetime.strptime(text, "%Y-%m-%d")


def golden_rows():
    """Four entities with three snapshots each.

    Fixed values: the rows for which the expected results are known.
    """
    entities = {
        "OPP-001": ("Deal Alpha", "2024-01-01", "Enterprise", "Alice"),
        "OPP-002": ("Deal Beta", "2024-01-05", "SMB", "Bob"),
        "OPP-003": ("Deal Gamma", "2024-01-10", "Government", "Carol"),
        "OPP-004": ("Deal Delta", "2024-01-15", "Enterprise", "David"),
    }
    snapshots = [
        ("OPP-001", "2024-01-01", "Lead", 100000, 0.20),
        ("OPP-001", "2024-01-15", "Budget", 120000, 0.25),
        ("OPP-001", "2024-01-30", "Closed - WON", 150000, 0.30),
        ("OPP-002", "2024-01-05", "Lead", 200000, 0.15),
        ("OPP-002", "2024-01-20", "Budget", 180000, 0.18),
        ("OPP-002", "2024-02-05", "Closed - LOST", 0, 0.00),
        ("OPP-003", "2024-01-10", "Lead", 300000, 0.25),
        ("OPP-003", "2024-01-25", "Budget", 320000, 0.28),
        ("OPP-003", "2024-02-10", "Negotiation", 350000, 0.30),
        ("OPP-004", "2024-01-15", "Lead", 400000, 0.10),
        ("OPP-004", "2024-02-01", "Budget", 450000, 0.12),
        ("OPP-004", "2024-02-15", "Closed - WON", 500000, 0.15),
    ]
    rows = []
    for key, at, stage, price, margin in snapshots:
        name, created, unit, owner = entities[key]
        rows.append((key, name, day(at), day(created), stage, price, margin, unit, owner))
    return rows


@pytest.fixture(scope="session")
def spark():
    session = local_session(4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def golden(spark):
    return spark.createDataFrame(golden_rows(), GOLDEN_SCHEMA)


@pytest.fixture(scope="session")
def roles():
    return Roles()


def by_key(df, key, value):
    return {r[key]: r[value] for r in df.collect()}
