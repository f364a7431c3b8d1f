import pytest

from inkfold.plans import queries as q
from tests.compare import rows_of_frame, rows_of_sql
from tests.conftest import DATA

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert rows_of_frame(q.queries()[name](spark, SF)) == rows_of_sql(SF, q.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(q.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    """Their values are compared in the tests of their operators; here, they have rows and the same ones again."""
    df = q.queries()[name](spark, SF)
    once, again = rows_of_frame(df), rows_of_frame(q.queries()[name](spark, SF))
    assert once == again and (once[1] or name.startswith("near_"))  # none at this size


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
