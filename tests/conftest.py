import pytest

import clickloom.session
from clickloom import schema
from clickloom.session import local_session
from frames import at


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    clickloom.session.local_folder = str(tmp_path_factory.mktemp("shared"))
    session = local_session(4, shuffle_partitions=4, app="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_events(spark):
    """Prepared events from dicts; everything not named gets a neutral value."""

    def build(rows):
        names = [f.name for f in schema.EVENTS.fields]
        full = []
        for i, row in enumerate(rows):
            base = dict.fromkeys(names)
            base.update(event_id=i, user_id="u1", session_id="s1", ts=at(i), page="/home", event_type="pageview")
            base.update(row)
            full.append(tuple(base[n] for n in names))
        return spark.createDataFrame(full, schema.EVENTS)

    return build


@pytest.fixture(scope="session")
def tables():
    return "/root/testdata/sf0.001"
