import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyhouse import schema as S  # noqa: E402
from tallyhouse.session import local_session  # noqa: E402
from tallyhouse.sources.manifest import FILES_COLUMNS, derive_columns  # noqa: E402

NOW = 1700000000


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture
def entries(spark):
    """Build `files` rows from (path, size) or (path, size, mtime); size None makes a directory."""

    def build(*rows, snapshot_id="2026-05-15_11-00", root="/"):
        listing = [
            (snapshot_id, path, size, None, (rest[0] if rest else NOW), size is None)
            for path, size, *rest in rows
        ]
        return derive_columns(spark.createDataFrame(listing, S.MANIFEST), root).select(FILES_COLUMNS)

    return build


@pytest.fixture
def seeded(entries):
    return entries(
        ("/a/big.bin", 16384),
        ("/a/mid.log", 4096),
        ("/a/small.txt", 256),
        ("/b/other.bin", 8192),
        ("/a", None),
        ("/b", None),
    )


def records(df):
    return [row.asDict(recursive=True) for row in df.collect()]
